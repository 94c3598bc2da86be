"""Report writers and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from ..functions import scoring as S
from ..operators.keyed import first_by


def write_ndjson(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def csv_rows(findings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Findings in report-column shape; lists joined with '; '."""
    t = findings.join(taxonomy, "invariant_id", "left")
    joined = lambda c: F.coalesce(F.array_join(c, "; "), F.lit("")) if c in taxonomy.columns else F.lit("")
    return t.select(
        F.col("severity").alias("Severity"), F.col("invariant_id").alias("Vulnerability_ID"),
        joined("cwe").alias("CWE"), joined("swc").alias("SWC"), joined("owasp_sc").alias("OWASP_SC"),
        F.col("file").alias("File"), F.col("line").alias("Line"), F.col("message").alias("Message"),
    )


def write_csv(findings: DataFrame, taxonomy: DataFrame, path: str) -> None:
    csv_rows(findings, taxonomy).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules of a repository in first-seen order with their index.

    One row per (repo, rule) is left before anything is ordered.
    """
    first = findings.groupBy("repo", "invariant_id").agg(
        F.min(F.struct("ord", "severity", "message")).alias("f")
    )
    order = Window.partitionBy("repo").orderBy("f.ord", "invariant_id")
    return first.select(
        "repo", "invariant_id", (F.row_number().over(order) - 1).cast("long").alias("rule_index"),
        F.split_part("f.message", F.lit("\n"), F.lit(1)).alias("short_description"),
        S.lookup(S.SARIF_LEVEL, F.col("f.severity")).alias("level"),
        S.lookup(S.SECURITY_SEVERITY, F.col("f.severity")).alias("security_severity"),
    )


def sarif_results(findings: DataFrame, rules: DataFrame) -> DataFrame:
    return findings.join(rules.select("repo", "invariant_id", "rule_index"), ["repo", "invariant_id"]).select(
        "repo", "invariant_id", "rule_index", S.lookup(S.SARIF_LEVEL, F.col("severity")).alias("level"),
        "message", "evidence", "file", F.col("line").alias("start_line"), (F.col("col") + 1).alias("start_column"),
    )


def sarif_taxa(rules: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Weakness classes of a repository's rules, numbered by class id."""
    classes = rules.join(taxonomy.select("invariant_id", F.explode("cwe").alias("cwe")), "invariant_id").select(
        "repo", "cwe"
    ).distinct()
    number = F.regexp_extract("cwe", "([0-9]+)", 1).cast("int")
    return classes.withColumn(
        "taxon_index", (F.row_number().over(Window.partitionBy("repo").orderBy(number)) - 1).cast("long")
    )


def sarif_tables(findings: DataFrame, taxonomy: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rules = sarif_rules(findings)
    return rules, sarif_results(findings, rules), sarif_taxa(rules, taxonomy)


def write_sarif_runs(findings: DataFrame, taxonomy: DataFrame, path: str) -> None:
    """SARIF material partitioned by repository: rules, results and taxa as JSON lines.

    Results stay rows: a document of millions of results never sits in one cell.
    """
    for name, table in zip(("rules", "results", "taxa"), sarif_tables(findings, taxonomy)):
        table.write.mode("overwrite").partitionBy("repo").json(f"{path}/{name}")


def drop_folders(spark: SparkSession, target: str, names: Sequence[str]) -> None:
    """Delete folders below ``target`` with the file system that holds it; missing ones do not matter."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(target, name)
        path.getFileSystem(conf).delete(path, True)


def upsert_findings(scan_rows: DataFrame, target: str, scans: Sequence | None = None) -> None:
    """Replace the findings of the scans in ``scan_rows``; other scans stay.

    Unique on (scan, fingerprint), the lowest row of each. The rows are computed once, into the shared folder; dynamic
    partition overwrite then swaps whole scan partitions at commit. ``scans`` names the scans that ran: one without rows found
    nothing, and its old partition is deleted, after the new rows stand. Ids may hold any characters.
    """
    spark = scan_rows.sparkSession
    rows = cut_lineage(first_by(scan_rows, ["scan_id", "fingerprint"], []), "upsert")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(target)
    if scans is not None:
        text = lambda s: None if s is None else str(s)
        ran = {text(r["scan_id"]) for r in rows.select("scan_id").distinct().collect()}  # at most one row per scan that ran
        drop_folders(spark, target, [partition_folder(spark, "scan_id", text(s)) for s in scans if text(s) not in ran])


def partition_folder(spark: SparkSession, column: str, value: str | None) -> str:
    """The folder that Spark gives a partition value: special characters are escaped, null has a name of its own."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, value)
