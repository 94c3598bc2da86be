"""Streaming queries: the event table read as a stream and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..dims import reference as REF
from ..functions import registry as REG
from ..operators import corpus as C, rules as R
from ..session import scratch_path
from ..streaming import streams as ST
from ..streaming.stateful import keyed_store, throttle_stream
from . import base as B
from .base import q, query, ql, with_ctes
from .q_invariants import DAY, SNAP, snapshots
from .q_ops import SCANS
from .q_rules import TEXT_PACK
from .rule_sql import pack_sql

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a file stream, bounded batches of whole files."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 16).parquet(_source(spark, sf))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _slice():
    """Slices of eight days; what is earlier or has no time is in the first, what is later in the last."""
    return F.coalesce(F.least(F.greatest(F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01")) / 8), F.lit(0)), F.lit(3)), F.lit(0))



def _source(spark: SparkSession, sf: str) -> str:
    """The table split by day into files, so a stream sees several batches in order."""
    path = scratch_path(spark, "events")
    e = B.table(spark, sf, "events")
    for d in range(4):
        e.filter(_slice() == d).write.mode("append").parquet(path)
    return path


def _inv():
    return {"positive": F.col("value") > 100, "bounded": F.when(F.col("event_id") % 9 > 0, F.col("value") < 300)}


@query("st1_stream_invariants", """
SELECT event_id, 'positive' AS invariant, CASE WHEN value > 100 THEN 'holds' ELSE 'violated' END AS outcome FROM events
UNION ALL SELECT event_id, 'bounded', CASE WHEN event_id % 9 = 0 THEN 'undecidable' WHEN value < 300 THEN 'holds' ELSE 'violated' END FROM events""")
def st1(spark, sf):
    s = ST.stream_invariants(events(spark, sf), ["event_id"], _inv(), ["value"]).drop("state")
    return ST.run_to_table(s, "st1")


def _closed(col: str, delay: str) -> str:
    return f"{col} <= (SELECT max(ts) - INTERVAL {delay} FROM events)"


@query("st2_interval_violations", f"""
WITH v AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS s, 'positive' AS invariant FROM events WHERE NOT value > 100
  UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01'), 'bounded' FROM events WHERE event_id % 9 > 0 AND NOT value < 300)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, invariant, count(*) AS violations FROM v WHERE {_closed("s + INTERVAL 1 HOUR", "1 MINUTE")} GROUP BY ALL""")
def st2(spark, sf):
    s = ST.interval_violations(events(spark, sf), _inv(), "1 hour", "1 minute")
    return ST.run_to_table(s, "st2").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "invariant", "violations")


@query("st3_throttle_alerts", """
WITH RECURSIVE s(event_type, k, ts) AS (SELECT event_type, user_id % 20, min(ts) FROM events WHERE ts IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT s.event_type, s.k, (SELECT min(e.ts) FROM events e WHERE e.event_type = s.event_type AND e.user_id % 20 = s.k AND e.ts >= s.ts + INTERVAL 172800 SECOND) FROM s WHERE s.ts IS NOT NULL)
SELECT event_type, k, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts FROM s WHERE ts IS NOT NULL""")
def st3(spark, sf):
    slices = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(_source_single(spark, sf))
    alerts = slices.select("event_type", (F.col("user_id") % 20).alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    with keyed_store(spark):
        sent = ST.run_to_table(throttle_stream(alerts, ["event_type", "k"], 172800), "st3")
    return sent.select("event_type", "k", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"))


@query("st3_throttle_from_last_sent", """
WITH RECURSIVE s(event_type, ts) AS (SELECT event_type, min(ts) FROM events GROUP BY 1
  UNION ALL SELECT s.event_type, (SELECT min(e.ts) FROM events e WHERE e.event_type = s.event_type AND e.ts >= s.ts + INTERVAL 172800 SECOND) FROM s WHERE s.ts IS NOT NULL)
SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM s WHERE ts IS NOT NULL""")
def st3b(spark, sf):
    e = B.table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return ST.throttle_from_last_sent(e, ["event_type"], 172800).select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


SINKS = (("pager", "pagerduty", ["Critical"]), ("chat", "slack", ["High", "Critical"]), ("log", "file", None))


@query("st4_route_alerts", with_ctes(B.FINDINGS, body="""
SELECT ord, 'pager' AS sink FROM findings WHERE severity = 'Critical' UNION ALL SELECT ord, 'chat' FROM findings WHERE severity IN ('High', 'Critical') UNION ALL SELECT ord, 'log' FROM findings"""))
def st4(spark, sf):
    sinks = spark.createDataFrame(SINKS, "sink string, type string, severities array<string>")
    stream = events(spark, sf).select(F.col("event_id").alias("ord"), F.get(F.array(*[F.lit(s) for s in B.LEVELS]), (F.col("user_id") % 5).cast("int")).alias("severity"))
    out = scratch_path(spark, "st4")
    ST.deliver(stream, sinks, lambda rows, no: rows.write.mode("overwrite").parquet(f"{out}/batch={no}"))
    return spark.read.parquet(out).select("ord", "sink")


def _snap_stream(spark, sf):
    k = F.col("event_id")
    return events(spark, sf).select(
        F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("entity"), "ts", "event_id",
        F.when(k % 9 > 0, F.round(F.col("value") * 100).cast("long")).alias("value"),
        F.when(k % 11 > 0, F.concat(F.lit("o"), (k % 7).cast("string"))).alias("owner"),
        F.concat(F.lit("o"), (k % 5).cast("string")).alias("caller"), F.col("event_type").alias("fn"))


@query("st5_stream_monotonic", with_ctes(SNAP, body="""
, p AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM snap)
SELECT entity, event_id, value, prev FROM p WHERE value < prev"""))
def st5(spark, sf):
    out = scratch_path(spark, "st5")
    ST.stream_monotonic(_snap_stream(spark, sf), ["entity"], ["ts", "event_id"], "value", out, DAY())
    return spark.read.parquet(out).select("entity", "event_id", "value", "prev")


@query("st5_stream_authorised_change", with_ctes(SNAP, body="""
, p AS (SELECT *, last_value(owner IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM snap)
SELECT entity, event_id, owner, prev AS prev_owner FROM p WHERE fn = 'purchase' AND owner <> prev AND caller <> prev"""))
def st5b(spark, sf):
    out = scratch_path(spark, "st5b")
    ST.stream_authorised_change(_snap_stream(spark, sf), ["entity"], ["ts", "event_id"], "purchase", out, DAY())
    return spark.read.parquet(out).select("entity", "event_id", "owner", F.col("prev").alias("prev_owner"))


@query("st6_stream_conservation", f"""
WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS s, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS summed FROM events GROUP BY ALL),
t AS (SELECT c_custkey AS user_id, CAST(c_custkey * 10 AS BIGINT) AS stated FROM customer)
SELECT strftime(s, '%Y-%m-%d') AS day, user_id, summed, stated FROM w JOIN t USING (user_id) WHERE summed <> stated AND {_closed("s + INTERVAL 1 DAY", "1 HOUR")}""")
def st6(spark, sf):
    cents = events(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    totals = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 10).alias("total"))
    s = ST.stream_conservation(cents, totals, "user_id", "cents", "total", "1 day", "1 hour")
    return ST.run_to_table(s, "st6").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "user_id", "summed", "stated")


@query("st7_finding_rate", f"""
WITH w AS (SELECT event_type AS invariant_id, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), INTERVAL 6 HOUR)) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, invariant_id, count(*) AS n FROM w WHERE {_closed("s + INTERVAL 24 HOUR", "10 MINUTE")} GROUP BY ALL""")
def st7(spark, sf):
    s = ST.finding_rate(events(spark, sf).withColumnRenamed("event_type", "invariant_id"), "24 hours", "6 hours", "10 minutes")
    return ST.run_to_table(s, "st7").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "invariant_id", "n")


@query("st7_finding_sessions", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 HOUR THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, no HAVING {_closed("max(ts) + INTERVAL 10 HOUR", "10 MINUTE")}""")
def st7b(spark, sf):
    s = ST.finding_sessions(events(spark, sf), "10 hours", "10 minutes", "user_id")
    return ST.run_to_table(s, "st7b").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("st8_stream_expire_leases", with_ctes(SCANS, body="""
SELECT scan_id, CASE WHEN status = 'processing' AND claimed_at + INTERVAL 10 MINUTE < (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)
  THEN CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END ELSE status END AS next_status FROM scans WHERE claimed_at IS NOT NULL"""))
def st8(spark, sf):
    # No scan has a second event: what ends a lease is the stream's time alone.
    k, t = F.col("event_id"), F.col("event_type")
    src = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(_source_single(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp"))
    s = src.select(
        k.alias("scan_id"), F.when(t == "view", "complete").when(t == "error", "failed").when(t == "click", "processing").otherwise("queued").alias("status"),
        (k % 5).alias("attempts"), F.col("ts").alias("claimed_at"), F.col("ts").alias("seen_at"))
    changes = ST.stream_expire_leases(s, scratch_path(spark, "st8"))
    return changes.groupBy("scan_id").agg(F.max_by("next_status", "at").alias("next_status"))


def _source_single(spark: SparkSession, sf: str) -> str:
    """The same slices, one file each and in time order."""
    path = scratch_path(spark, "slices")
    e = B.table(spark, sf, "events")
    import time

    for d in range(4):
        e.filter(_slice() == d).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # file sources order by modification time, to the second
    return path


@query("st9_incremental_scan", pack_sql(TEXT_PACK, "repo, file, line, invariant_id").replace(B.CODE_FILES, B.FILES.replace("files AS", "code_files AS", 1)))
def st9(spark, sf):
    path = scratch_path(spark, "files")
    B.files(spark, sf).write.parquet(path)
    stream = spark.readStream.schema("repo string, path string, source string").option("maxFilesPerTrigger", 1).parquet(path)
    target = scratch_path(spark, "st9")
    scan = lambda files: R.scan_files(files, TEXT_PACK).withColumn("fingerprint", F.concat_ws("|", "repo", "file", "line", "invariant_id"))
    ST.incremental_scan(stream, scan, target)
    return spark.read.parquet(target).select("repo", "file", "line", "invariant_id")


@query("st10_late_findings", """
WITH b AS (SELECT *, least(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 8), 3) AS batch0 FROM events),
c AS (SELECT *, CASE batch0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE batch0 END AS batch FROM b),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM c GROUP BY batch)
SELECT event_id, coalesce(ts < high - INTERVAL 1 HOUR, false) AS late FROM c JOIN m USING (batch)""")
def st10(spark, sf):
    import time

    path = scratch_path(spark, "shuffled")
    e = B.table(spark, sf, "events")
    for d in (0, 2, 1, 3):  # the second slice arrives after the third
        e.filter(_slice() == d).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "st10")
    ST.late_findings(s, "1 hour", out)
    late = spark.read.schema(s.schema).parquet(out + "/late").select("event_id", F.lit(True).alias("late"))
    return late.unionByName(spark.read.schema(s.schema).parquet(out + "/ontime").select("event_id", F.lit(False).alias("late")))


# ---- extension points -----------------------------------------------------------------

@query("ud1_sql_functions", with_ctes(B.FINDINGS, body="SELECT ord, sha256(severity || chr(0) || invariant_id || chr(0) || file || chr(0) || line) AS fp, CASE lower(severity) WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS gate FROM findings"))
def ud1(spark, sf):
    REG.register_sql_functions(spark)
    return B.findings(spark, sf).select("ord", F.expr("finding_fingerprint(severity, invariant_id, file, line)").alias("fp"), F.expr("gate_rank(severity)").alias("gate"))


@query("ud2_pluggable_detector", with_ctes(B.FILES, B.LINES, body="SELECT repo, path AS file, 'long_line' AS invariant_id, line FROM lines WHERE length(text) > 2000"))
def ud2(spark, sf):
    def check(source: str, path: str):
        for no, text in enumerate(source.split("\n"), 1):
            if len(text) > 2000:
                yield "long_line", "Low", no, "line is very long"

    found = REG.run_detector(B.files(spark, sf), REG.detector(check))
    return found.select("repo", "file", "invariant_id", "line")


@query("ud3_pluggable_invariant", "SELECT event_id, 'even_or_small' AS invariant, CASE WHEN event_id % 2 = 0 OR value < 50 THEN 'holds' ELSE 'violated' END AS outcome FROM events")
def ud3(spark, sf):
    from ..operators.invariants import check_invariants

    plug = {"even_or_small": lambda: (F.col("event_id") % 2 == 0) | (F.col("value") < 50)}
    return check_invariants(B.table(spark, sf, "events"), ["event_id"], {n: f() for n, f in plug.items()}, ["value"]).drop("state")


_KINDS = ("Python", "JavaScript", "Go", "Shell", "ContainerManifest", "Terraform", "Config", "Other")
_USER_RULE = R.Rule("user_contact", _KINDS, "Low", "[a-z0-9]@[a-z0-9]", "contact")


@query("ud4_user_rule_files", pack_sql([_USER_RULE], "repo, file, line, invariant_id").replace(B.CODE_FILES, B.FILES.replace("files AS", "code_files AS", 1)))
def ud4(spark, sf):
    from ..sources.readers import RULE_ROW, read_rules

    path = scratch_path(spark, "rules")
    r = _USER_RULE
    row = [(r.rule_id, list(r.kinds), r.severity, r.pattern, r.message, None, 0, 0, None, None, None, None, None, None)]
    spark.createDataFrame(row, RULE_ROW).write.json(path)
    return R.scan_files(B.files(spark, sf), read_rules(spark, path)).select("repo", "file", "line", "invariant_id")


@query("ud5_worst_by_rank", with_ctes(B.FINDINGS, body="SELECT repo, arg_max(severity, CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) AS worst FROM findings GROUP BY repo"))
def ud5(spark, sf):
    from ..functions.scoring import severity_rank

    return B.findings(spark, sf).groupBy("repo").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("worst"))
