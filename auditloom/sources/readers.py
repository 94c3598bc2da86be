"""Readers with explicit schemas for every input the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import versions as V
from .tree import SKIPPED_FOLDERS, open_tree, read_tree

def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """files(repo, path, source) below ``root/<repo>/...``; non-UTF-8 files are dropped.

    Folders that never hold source are neither listed nor read. A file system that only the JVM knows
    is listed by Spark; there, narrower roots or globs keep such folders from being listed.
    """
    try:
        open_tree(root)
    except (ValueError, OSError, NotImplementedError):
        return _read_listed(spark, root)
    return read_tree(spark, root)


def _read_listed(spark: SparkSession, root: str) -> DataFrame:
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    # Listed paths carry scheme and host as the qualified root does; only slashes after the scheme vary.
    scheme, _, rest = whole.partition(":")
    rel = F.regexp_extract("path", rf"^\Q{scheme}\E:/*\Q{rest.lstrip('/')}\E/([\s\S]*)$", 1)
    folders = "|".join(d.replace(".", r"\.") for d in SKIPPED_FOLDERS)
    kept = raw.select(rel.alias("rel"), "content").filter(~F.col("rel").rlike(f"(^|/)({folders})/"))
    return kept.select(
        F.substring_index("rel", "/", 1).alias("repo"),
        F.regexp_extract("rel", "^[^/]*/(.*)$", 1).alias("path"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("source"),
    ).filter(F.col("source").isNotNull())


def read_findings_json(spark: SparkSession, path: str, kind: str = "scan") -> DataFrame:
    """Findings of saved reports of one kind: scan, probe or symbolic.

    Only symbolic reports say whether they ran; one that did not stops the read, as its
    silence would look like a clean result.
    """
    doc = spark.read.schema(schemas.REPORT).option("multiLine", True).json(path)
    if kind == "symbolic":
        failed = F.raise_error(F.concat(F.lit("symbolic report did not run: "), F.coalesce("repo", F.lit("?"))))
        doc = doc.filter(F.when(F.coalesce("ran", F.lit(False)), True).otherwise(failed.cast("boolean")))
    return doc.select("repo", F.posexplode("findings").alias("ord", "f")).select(
        "repo", F.col("ord").cast("long").alias("ord"), "f.*"
    )


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """OSV documents to one row per affected package."""
    return normalize_osv(spark.read.schema(schemas.OSV).option("multiLine", True).json(path))


# Ecosystems by their lower-case OSV name.
ECOSYSTEMS = {"crates.io": "crates.io", "npm": "npm", "pypi": "PyPI", "go": "Go"}


def normalize_osv(docs: DataFrame) -> DataFrame:
    eco = F.create_map(*[F.lit(x) for kv in ECOSYSTEMS.items() for x in kv])
    cvss = F.get(F.filter("severity", lambda s: s["type"].startswith("CVSS")), F.lit(0))["score"]
    ranges = F.flatten(
        F.transform(
            F.filter("a.ranges", lambda r: r["type"].isin("SEMVER", "ECOSYSTEM")),
            lambda r: V.osv_ranges(r["events"]),
        )
    )
    none = F.array().cast("array<string>")
    empty_ranges = F.array().cast("array<struct<intro:string,end:string,inclusive:boolean>>")
    return docs.select(
        "id", F.split_part(F.coalesce("summary", "details", F.lit("")), F.lit("\n"), F.lit(1)).alias("summary"),
        F.coalesce("aliases", none).alias("aliases"), V.cvss_score(cvss).alias("score"),
        F.col("database_specific.informational").alias("informational"), F.explode("affected").alias("a"),
    ).select(
        "id", "summary", "aliases", "score", "informational",
        eco[F.lower("a.package.ecosystem")].alias("ecosystem"), F.col("a.package.name").alias("name"),
        F.coalesce(ranges, empty_ranges).alias("ranges"), F.coalesce("a.versions", none).alias("versions"),
        none.alias("patched"), none.alias("unaffected"),
    ).filter(F.col("ecosystem").isNotNull())


def read_rustsec(spark: SparkSession, path: str) -> DataFrame:
    """Advisory markdown files with a fenced TOML head."""
    return normalize_rustsec(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "text"))


def normalize_rustsec(docs: DataFrame) -> DataFrame:
    toml = F.regexp_extract("text", r"(?s)```toml(.*?)```", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract("toml", rf"(?m)^\s*{k} = (.*)$", 1), F.lit('" ')), F.lit(""))
    listed = lambda k: F.filter(
        F.transform(
            F.regexp_extract_all(F.regexp_extract("toml", rf"(?s){k} = \[(.*?)\]", 1), F.lit('"([^"]*)"'), F.lit(1)),
            lambda v: F.trim(v),
        ),
        lambda v: v != "",
    )
    d = docs.withColumn("toml", toml).filter(F.col("toml") != "")
    d = d.withColumn("patched", listed("patched")).withColumn("unaffected", listed("unaffected"))
    everything = F.array(F.struct(
        F.lit("0").alias("intro"), F.lit(None).cast("string").alias("end"), F.lit(False).alias("inclusive")))
    empty = F.array().cast("array<struct<intro:string,end:string,inclusive:boolean>>")
    return d.select(
        field("id").alias("id"), F.regexp_extract("text", r"(?m)^# (.*)$", 1).alias("summary"),
        listed("aliases").alias("aliases"), V.cvss_score(field("cvss")).alias("score"),
        field("informational").alias("informational"), F.lit("crates.io").alias("ecosystem"),
        field("package").alias("name"),
        F.when(F.size("patched") + F.size("unaffected") == 0, everything).otherwise(empty).alias("ranges"),
        F.array().cast("array<string>").alias("versions"), "patched", "unaffected",
    ).filter(F.col("id").isNotNull() & F.col("name").isNotNull())


# How a path of a commit is classified.
SOURCE_FILE = r"\.(sol|vy|rs|move|cairo)$"
TEST_HINT = r"test/|tests/|spec/|\.t\.sol|\.spec\.|__tests__|fuzz/|_tests?\.move|trident-tests/"
EXCLUDED = r"/(lib|node_modules|forge-std|out|broadcast|artifacts|cache|target|build|dist|recon)/"
LOG_MARK = "COMMIT_START<<SEP>>"


def read_commits(spark: SparkSession, path: str, src_dir: str = "", repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Numstat log exports to (commits, commit_files), of one repository or of many.

    A log belongs to the repository ``repo``; unless it is given, to the one that names its folder or file: `repo=<name>`
    below ``path`` (as Spark partitions a table), else the file's own name without ending. The record separator is the line break before each mark, so the export
    splits into commits while it is read.
    """
    raw = spark.read.option("lineSep", LOG_MARK).text(path).filter(F.col("value") != "")
    head = F.split(F.split_part("value", F.lit("\n"), F.lit(1)), "<<SEP>>")
    at = lambda i: F.get(head, F.lit(i))
    if repo is not None:
        name = F.lit(repo)
    elif "repo" in raw.columns:
        name = F.col("repo").cast("string")
    else:
        name = F.regexp_replace(F.url_decode(F.substring_index(F.col("_metadata.file_path"), "/", -1)), r"\.[^.]*$", "")
    rec = raw.filter(F.size(head) >= 6).select(
        name.alias("repo"), at(0).alias("sha"), at(1).alias("short_sha"), F.try_to_date(F.substring(at(2), 1, 10)).alias("date"),
        at(3).alias("author"), F.contains(F.trim(at(4)), F.lit(" ")).alias("is_merge"), at(5).alias("subject"),
        F.split("value", "\n").alias("lines"),
    )
    commits = rec.select("repo", "sha", "short_sha", "date", "author", "subject", "is_merge")
    rows = rec.select("repo", "sha", F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("l")).filter(F.col("l").rlike(r"^(\d+|-)\t(\d+|-)\t"))
    cell = F.split("l", "\t")
    number = lambda i: F.coalesce(F.get(cell, F.lit(i)).try_cast("bigint"), F.lit(0))
    p = F.get(cell, F.lit(2))
    is_test = F.lower(p).rlike(TEST_HINT)
    files = rows.select(
        "repo", "sha", p.alias("path"), number(0).alias("added"), number(1).alias("deleted"),
        (p.rlike(SOURCE_FILE) & ~F.concat(F.lit("/"), p).rlike(EXCLUDED) & p.startswith(src_dir) & ~is_test).alias("is_source"),
        is_test.alias("is_test"),
    )
    return commits, files


def read_exploits(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Known exploits: one JSON document a file, or, with ``multi_line`` off, one a line, which splits over tasks."""
    return spark.read.schema(schemas.EXPLOITS).option("multiLine", multi_line).json(path)


def read_observations(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """HTTP, TLS, port or path observations as JSON lines."""
    schema = {
        "http": schemas.HTTP_OBSERVATION, "tls": schemas.TLS_OBSERVATION,
        "port": schemas.PORT_OBSERVATION, "path": schemas.PATH_OBSERVATION,
    }[kind]
    return spark.read.schema(schema).json(path)


def read_acceptances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ACCEPTANCE).json(path)


RULE_ROW = """
  rule_id string, kinds array<string>, severity string, pattern string, message string,
  unless string, near_before int, near_after int, near_has string, near_lacks string,
  file_has string, file_lacks string, func_has string, func_lacks string
"""


def read_rules(spark: SparkSession, path: str):
    """A user's rule file as rules for the scan operator.

    Rules are code: they become expressions of the plan, so they come to the driver. Long
    lists run as several packs (``rules.packs_of``).
    """
    from ..operators.rules import Rule

    rows = spark.read.schema(RULE_ROW).json(path).collect()
    optional = ("unless", "near_has", "near_lacks", "file_has", "file_lacks", "func_has", "func_lacks")
    return tuple(
        Rule(
            r["rule_id"], tuple(r["kinds"]), r["severity"], r["pattern"], r["message"],
            near=(r["near_before"] or 0, r["near_after"] or 0), **{c: r[c] for c in optional},
        )
        for r in rows
    )
