"""Security-findings analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames (or Columns); nothing here
collects data to the driver except scalar progress counts of graph loops.
"""
