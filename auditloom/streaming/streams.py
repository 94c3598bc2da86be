"""Invariants, alerts and scans on event streams (Structured Streaming).

Windowed work uses the engine's own incremental aggregation. Per-key history
(monotonic values, owners) runs per micro-batch through the same chunked batch
operators, seeded from a small state table: a hot key in a batch splits over
tasks, which a per-key state function cannot do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import invariants as INV
from ..session import cut_counted, cut_lineage, scratch_path
from ..sources.writers import drop_folders, upsert_findings
from .stateful import keyed_store, lease_changes

SINK_TYPES = INV.SINKS


# ---- running a stream to completion --------------------------------------------------

#: Drain what is there, then stop. Others pass what ``DataStreamWriter.trigger`` takes.
DRAIN = {"availableNow": True}


def _log(spark: SparkSession, label: str, out: str | None, checkpoint: str | None) -> str:
    """Where a stream keeps its place: as told, else beside its output, so the next call goes on from there."""
    return checkpoint or (f"{out}-log" if out else scratch_path(spark, label + "-log"))


def run_to_table(
    stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None, trigger: dict | None = None
) -> DataFrame:
    """Drain what is available into an append table and read it back."""
    spark = stream.sparkSession
    out = path or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(**(trigger or DRAIN))
        .option("checkpointLocation", _log(spark, label, path, checkpoint)).start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(
    stream: DataFrame, label: str, step: Callable[[DataFrame, int], None], checkpoint: str | None = None,
    out: str | None = None, trigger: dict | None = None,
) -> None:
    """Drain what is available through a per-batch function; batch numbers go on with the checkpoint."""
    spark = stream.sparkSession
    query: StreamingQuery = (
        stream.writeStream.foreachBatch(step).trigger(**(trigger or DRAIN))
        .option("checkpointLocation", _log(spark, label, out, checkpoint)).start()
    )
    query.awaitTermination()


# ---- stateless and windowed -------------------------------------------------------

def stream_invariants(stream: DataFrame, keys: Sequence[str], exprs: dict[str, Column], state: Sequence[str]) -> DataFrame:
    return INV.check_invariants(stream, keys, exprs, state)


def interval_violations(stream: DataFrame, exprs: dict[str, Column], interval: str = "12 seconds", watermark: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Violations per invariant per tumbling interval."""
    checked = INV.check_invariants(stream.withWatermark(ts, watermark), [ts], exprs, [ts])
    return checked.filter(F.col("outcome") == "violated").groupBy(F.window(ts, interval), "invariant").agg(
        F.count("*").alias("violations")
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "invariant", "violations")


def finding_rate(stream: DataFrame, window: str = "10 minutes", slide: str = "1 minute", watermark: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Findings per rule in sliding windows."""
    return stream.withWatermark(ts, watermark).groupBy(F.window(ts, window, slide), "invariant_id").agg(
        F.count("*").alias("n")
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "invariant_id", "n")


def finding_sessions(stream: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes", key: str = "repo", ts: str = "ts") -> DataFrame:
    """Bursts of findings per repository, closed by a quiet gap."""
    return stream.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), key).agg(
        F.count("*").alias("n")
    ).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def stream_conservation(stream: DataFrame, totals: DataFrame, key: str, amount: str, total: str, window: str, watermark: str, ts: str = "ts") -> DataFrame:
    """Windowed sums per entity that differ from the entity's stated total."""
    sums = stream.withWatermark(ts, watermark).groupBy(F.window(ts, window), key).agg(F.sum(amount).alias("summed"))
    return sums.join(totals, key).filter(F.col("summed") != F.col(total)).select(
        F.col("window.start").alias("start"), key, "summed", F.col(total).alias("stated")
    )


# ---- alerts -------------------------------------------------------------------------

def throttle_alerts(alerts: DataFrame, identity: Sequence[str], seconds: int = 300, ts: str = "ts", spread: Sequence[str] | None = None, salts: int = 32) -> DataFrame:
    """Suppress repeats of an alert within ``seconds`` of its first sighting.

    With ``spread`` columns given, repeats are first dropped per (identity,
    salt), so an alert that makes up a third of the stream reaches the final
    de-duplication as at most ``salts`` rows per period.
    """
    marked = alerts.withWatermark(ts, f"{seconds} seconds")
    if spread:
        salted = marked.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        marked = salted.dropDuplicatesWithinWatermark([*identity, "_salt"]).drop("_salt")
    return marked.dropDuplicatesWithinWatermark(list(identity))


def throttle_from_last_sent(alerts: DataFrame, identity: Sequence[str], seconds: int, ts: str = "ts") -> DataFrame:
    """Exact throttle over a finished table: send, then stay quiet for ``seconds``.

    Each alert's successor is the first one of its identity that may be sent after it. Successors form a forest, and
    what is sent is the path from an identity's first alert. The path is marked by doubling: the marked alerts'
    successors 1, 2, 4, ... further on are marked too, so there are as many rounds as the logarithm of the busiest
    identity's sendings. Successors come from time chunks, so a busy identity is never sorted whole. Rows without a
    time are not sent; null identities are identities.
    """
    from ..operators.keyed import carry_forward, join_keys

    keys, at = list(identity), [*identity, ts]
    times = cut_lineage(alerts.select(*at).filter(F.col(ts).isNotNull()).distinct(), "alerts")
    # Walking backwards in time, the last alert passed is the next one in time; an alert at the very end of a period counts.
    back = -F.unix_micros(ts)
    points = times.select(*keys, back.alias("_back"), F.lit(0).alias("_asks"), F.col(ts).alias("_at"))
    asks = times.select(*keys, (back - seconds * 1_000_000).alias("_back"), F.lit(1).alias("_asks"), F.col(ts).alias("_at"))
    walked = carry_forward(points.unionByName(asks), keys, ["_back", "_asks"], F.floor(F.col("_back") / 3_600_000_000), F.when(F.col("_asks") == 0, F.col("_at")), "_next")
    onward = cut_lineage(walked.filter("_asks = 1 and _next is not null").select(*keys, F.col("_at").alias(ts), "_next"), "onward")
    sent, far = cut_lineage(times.groupBy(*keys).agg(F.min(ts).alias(ts)), "sent"), 1
    while far:
        reached = join_keys(sent, onward, at).select(*keys, F.col("_next").alias(ts))
        sent = cut_lineage(sent.unionByName(reached), "sent")
        over = onward.select(*keys, F.col(ts).alias("_next"), F.col("_next").alias("_over"))
        onward, far = cut_counted(join_keys(onward, over, [*keys, "_next"]).select(*at, F.col("_over").alias("_next")), "onward")
    return sent


def validate_sinks(sinks: DataFrame) -> DataFrame:
    return sinks.filter(~F.col("type").isin(*SINK_TYPES))


def route_alerts(alerts: DataFrame, sinks: DataFrame) -> DataFrame:
    """One row per (alert, sink) whose severity filter admits it; no filter admits all.

    ``sinks(sink, type, severities)`` with NULL or empty severities for "all", whatever an
    alert's severity is, NULL included. An alert asks twice, for its severity and for
    sinks without a filter, so both are one equi-join.
    """
    anything = F.struct(F.lit(True).alias("every"), F.lit("").alias("severity"))
    named = F.transform(F.array_distinct("severities"), lambda s: F.struct(F.lit(False).alias("every"), s.alias("severity")))
    wanted = F.when(F.coalesce(F.size("severities"), F.lit(0)) <= 0, F.array(anything)).otherwise(named)
    rows = sinks.select("sink", "type", F.explode(wanted).alias("_asks"))
    own = F.struct(F.lit(False).alias("every"), F.coalesce("severity", F.lit("")).alias("severity"))
    return alerts.withColumn("_asks", F.explode(F.array(anything, own))).join(rows, "_asks").drop("_asks")


def deliver(stream: DataFrame, sinks: DataFrame, send: Callable[[DataFrame, int], None], label: str = "alerts", checkpoint: str | None = None) -> None:
    """Fan a stream out per batch; an unknown sink type stops before anything is sent."""
    bad = validate_sinks(sinks).limit(1).take(1)
    if bad:
        raise ValueError(f"unknown sink type: {bad[0]['type']}")
    run_batches(stream, label, lambda batch, no: send(route_alerts(batch, sinks), no), checkpoint)


# ---- per-key history ------------------------------------------------------------------

class BatchState:
    """The last value per key after each batch, one folder per batch.

    Replaying a batch reads the same earlier folder and overwrites its own, so
    a restart gives the same rows. Only the last two folders stay: a batch
    can be replayed until the next one is done.
    """

    def __init__(self, stream: DataFrame, path: str, keys: Sequence[str], column: str, value: str):
        types = dict(stream.dtypes)
        self.spark, self.path, self.keys, self.value = stream.sparkSession, path, list(keys), value
        self.schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"`{value}` {types[column]}"])

    def before(self, batch: int) -> DataFrame:
        if batch == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch - 1}")

    def save(self, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        drop_folders(self.spark, self.path, [f"batch={batch - 2}"])


def _history_step(state: BatchState, order: Sequence[str], value: str, out: str, judge: Callable[[DataFrame], DataFrame], chunk: Column):
    from ..operators.keyed import carry_forward, join_keys

    keys = state.keys

    def step(batch: DataFrame, no: int) -> None:
        old = state.before(no)
        walked = carry_forward(batch, keys, order, chunk, F.col(value), "prev")
        seeded = join_keys(walked, old.withColumnRenamed(state.value, "_seed"), keys, "left").withColumn(
            "prev", F.coalesce("prev", "_seed")
        ).drop("_seed")
        judge(seeded).write.mode("overwrite").parquet(f"{out}/batch={no}")
        latest = batch.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
            F.max_by(value, F.struct(*order)).alias("_new")
        )
        both = old.withColumn("_age", F.lit(0)).unionByName(latest.select(*keys, F.col("_new").alias(state.value), F.lit(1).alias("_age")))
        state.save(no, both.groupBy(*keys).agg(F.max_by(state.value, "_age").alias(state.value)))

    return step


def stream_monotonic(stream: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, chunk: Column, checkpoint: str | None = None) -> None:
    """Append rows whose value fell below the key's previous value; state and place live beside the output."""
    state = BatchState(stream, out + "-state", keys, value, "last_value")
    judge = lambda df: df.filter(F.col(value) < F.col("prev"))
    run_batches(stream, "monotonic", _history_step(state, order, value, out, judge, chunk), checkpoint, out)


def stream_authorised_change(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], guarded: str, out: str, chunk: Column,
    owner: str = "owner", caller: str = "caller", fn: str = "fn", checkpoint: str | None = None,
) -> None:
    state = BatchState(stream, out + "-state", keys, owner, "last_owner")
    judge = lambda df: df.filter(
        (F.col(fn) == guarded) & (F.col(owner) != F.col("prev")) & (F.col(caller) != F.col("prev"))
    )
    run_batches(stream, "authorised", _history_step(state, order, owner, out, judge, chunk), checkpoint, out)


# ---- scan operations -------------------------------------------------------------------

def stream_expire_leases(stream: DataFrame, out: str, lease_ms: int = 600_000, max_attempts: int = 3, watermark: str = "1 minute", checkpoint: str | None = None) -> DataFrame:
    """Every change of status, leases that ran out in silence included; see :func:`stateful.lease_changes`.

    The place is kept beside the output, so a later call goes on with the leases that still run.
    """
    with keyed_store(stream.sparkSession):
        return run_to_table(lease_changes(stream, lease_ms, max_attempts, watermark), "leases", out, checkpoint)


def incremental_scan(files: DataFrame, scan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str | None = None, parts: int = 64) -> None:
    """New files through a scan with an idempotent sink: a replayed batch replaces its partition.

    Scans are numbered by batch; the place is kept beside the target, so the numbers go on. A batch is dealt over ``parts``
    tasks before it is scanned: it may come as one stored file, which one task would read and scan.
    """

    def step(batch: DataFrame, no: int) -> None:
        upsert_findings(scan(batch.repartition(parts)).withColumn("scan_id", F.lit(no).cast("long")), target, [no])

    run_batches(files, "scan", step, checkpoint, target)


def late_findings(stream: DataFrame, delay: str, out: str, ts: str = "ts", checkpoint: str | None = None) -> None:
    """Rows older than everything already seen minus ``delay`` go to ``out/late``, others to ``out/ontime``."""
    spark = stream.sparkSession
    marks = f"{out}-marks"

    def step(batch: DataFrame, no: int) -> None:
        if no == 0:
            high = F.lit(None).cast("timestamp")
        else:
            high = spark.read.schema("high timestamp").parquet(f"{marks}/batch={no - 1}").agg(F.max("high")).scalar()
        late = F.coalesce(F.col(ts) < high - F.expr(f"interval {delay}"), F.lit(False))
        judged = batch.withColumn("_late", late)
        judged.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{out}/late/batch={no}")
        judged.filter("not _late").drop("_late").write.mode("overwrite").parquet(f"{out}/ontime/batch={no}")
        batch.agg(F.greatest(F.max(ts), high).alias("high")).write.mode("overwrite").parquet(f"{marks}/batch={no}")

    run_batches(stream, "late", step, checkpoint, out)
