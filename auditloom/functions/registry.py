"""User extension points: SQL functions, detectors and rule files.

Columns stay the first choice. A function registered here is for SQL users; a
detector is a table function called with a lateral join, one file at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

# The columns every pluggable detector yields.
DETECTOR_RETURN = "invariant_id string, severity string, line bigint, message string"


def register_sql_functions(spark: SparkSession) -> None:
    """SQL functions with a native body: no Python runs per row."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION finding_fingerprint(severity STRING, name STRING, file STRING, line BIGINT) "
        "RETURNS STRING RETURN sha2(concat_ws(char(0), coalesce(severity, ''), coalesce(name, ''), "
        "coalesce(file, ''), coalesce(cast(line AS STRING), '')), 256)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION gate_rank(severity STRING) RETURNS INT RETURN "
        "CASE lower(severity) WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END"
    )


def detector(check: Callable[[str, str], Iterator[tuple[str, str, int, str]]]) -> UserDefinedTableFunction:
    """A table function from a plain ``check(source, path)`` generator."""

    class Detector:
        def eval(self, source: str, path: str):
            yield from check(source, path)

    return F.udtf(Detector, returnType=DETECTOR_RETURN, useArrow=True)


def run_detector(files: DataFrame, udtf: UserDefinedTableFunction, name: str = "pluggable_detector") -> DataFrame:
    """Findings of a pluggable detector over every file (lateral join, no shuffle)."""
    spark = files.sparkSession
    spark.udtf.register(name, udtf)
    files.createOrReplaceTempView(f"{name}_files")
    return spark.sql(
        f"SELECT f.repo, f.path AS file, d.* FROM {name}_files f, LATERAL {name}(f.source, f.path) d"
    )
