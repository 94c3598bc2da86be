"""Per-key state with timers: leases that run out in silence, and throttles that count from the last sending.

Both need to act when nothing arrives, or to know exactly what was sent, so they keep a small value per key in the
engine's state store. A key's rows of one batch are one task's work, a row at a time in time order; alerts and lease
events of one key are few by nature. Where one alert may make up a large part of a stream,
:func:`streams.throttle_alerts` salts it instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession):
    """The state store that timers need, for streams started inside; the session's own choice returns after."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class _Leases(StatefulProcessor):
    """Holds the running leases of one share of the scans: when each ends and how often its scan was tried."""

    def __init__(self, max_attempts: int):
        self.max_attempts = max_attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.running = handle.getValueState("leases", "held binary")

    def _held(self) -> pd.DataFrame:
        held = self.running.get()
        return pd.DataFrame(np.frombuffer(held[0] if held else b"", np.int64).reshape(-1, 3), columns=["scan", "ends_ms", "attempts"])

    def _hold(self, leases: pd.DataFrame, timer: int | None) -> None:
        # One timer a share, for the lease that ends first.
        soonest = int(leases["ends_ms"].min()) if len(leases) else None
        if len(leases):
            self.running.update((leases[["scan", "ends_ms", "attempts"]].to_numpy(np.int64).tobytes(),))
        else:
            self.running.clear()
        if timer is not None and timer != soonest:
            self.handle.deleteTimer(timer)
        if soonest is not None and timer != soonest:
            self.handle.registerTimer(soonest)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _in_order(rows, ["seen_ms"])
        held, last = self._held(), rows.drop_duplicates("scan", keep="last")
        timer = int(held["ends_ms"].min()) if len(held) else None
        stay = held[~held["scan"].isin(last["scan"])]
        if len(stay) < len(held) or last["runs"].any():
            self._hold(pd.concat([stay, last.loc[last["runs"], list(held.columns)]]), timer)
        yield pd.DataFrame({"scan": rows["scan"], "known": rows["known"], "next_status": rows["status"], "at_ms": rows["seen_ms"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        over = held["ends_ms"] < timerValues.getCurrentWatermarkInMs()
        self._hold(held[~over], None)  # the timer that went off is gone
        ended = held[over]
        status = (ended["attempts"] < self.max_attempts).map({True: "queued", False: "failed"})
        yield pd.DataFrame({"scan": ended["scan"], "known": bool(key[0] >= 0), "next_status": status.astype(object), "at_ms": ended["ends_ms"]})

    def close(self) -> None:
        pass


def lease_changes(stream: DataFrame, lease_ms: int = 600_000, max_attempts: int = 3, watermark: str = "1 minute", shares: int = 128) -> DataFrame:
    """A stream of (scan_id, next_status, at): every status seen, and what becomes of leases that run out.

    ``stream(scan_id, status, attempts, claimed_at, seen_at)``. A processing scan that says nothing for ``lease_ms``
    after its claim is queued again while it has attempts left, else failed: a timer does this once the stream's
    own time passes the end of the lease, no event of the scan is needed. Any later event of the scan
    replaces its lease. Null attempts count as none; without a claim time a lease never ends. Rows without
    ``seen_at`` or behind the watermark are not judged.

    Scans are dealt over ``shares`` by a hash: a share's rows of one batch and its running leases are handled at once, as
    columns, since a call and a state a scan cost far more than its row. ``shares`` stays as it is while a checkpoint is used.
    """
    claimed = F.unix_millis("claimed_at")
    runs = F.coalesce((F.col("status") == "processing") & claimed.isNotNull(), F.lit(False))
    scan = F.col("scan_id").cast("long")
    rows = stream.select(
        # Scans without an id are one, in a share of their own.
        F.when(scan.isNull(), -1).otherwise(F.pmod(F.xxhash64(scan), F.lit(shares))).cast("long").alias("share"),
        F.coalesce(scan, F.lit(0)).alias("scan"), scan.isNotNull().alias("known"), "status", runs.alias("runs"),
        F.coalesce(claimed + lease_ms, F.lit(0)).cast("long").alias("ends_ms"), F.coalesce(F.col("attempts").cast("long"), F.lit(0)).alias("attempts"),
        F.unix_millis("seen_at").alias("seen_ms"), "seen_at",
    ).filter("seen_at is not null").withWatermark("seen_at", watermark)
    out = rows.groupBy("share").transformWithStateInPandas(
        _Leases(max_attempts), "scan long, known boolean, next_status string, at_ms long", "Append", "EventTime",
    )
    return out.select(F.when(F.col("known"), F.col("scan")).alias("scan_id"), "next_status", F.timestamp_millis("at_ms").alias("at"))


class _Throttle(StatefulProcessor):
    """Holds when an alert was last sent, until the quiet period is over."""

    def __init__(self, columns: list[str], quiet_us: int):
        self.columns, self.quiet_us = columns, quiet_us

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("sent", "sent_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _in_order(rows, ["throttle_us"])
        sent, keep = self.last.get()[0] if self.last.exists() else None, []
        old = sent
        for us in rows["throttle_us"].tolist():
            keep.append(sent is None or us >= sent + self.quiet_us)
            if keep[-1]:
                sent = us
        if sent is not None and sent != old:
            if old is not None:
                self.handle.deleteTimer(self._over(old))
            self.last.update((sent,))
            self.handle.registerTimer(self._over(sent))
        if any(keep):
            yield rows.loc[keep, self.columns]

    def _over(self, sent: int) -> int:
        return (sent + self.quiet_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()  # nothing to remember: what comes now is sent in any case
        return iter(())

    def close(self) -> None:
        pass


def throttle_stream(alerts: DataFrame, identity: Sequence[str], seconds: int, ts: str = "ts", watermark: str = "1 minute") -> DataFrame:
    """The alerts that are sent: one, then none of the same identity for ``seconds`` from that sending on.

    Exact for alerts that arrive in the order of time from batch to batch; inside a batch they are put in order. State
    is dropped when the quiet period is over. Alerts of one time and identity count once (the first is sent). Null
    identities are identities; rows without a time are not sent.
    """
    keys, columns = list(identity), alerts.columns
    # Rows reach the state function by name; names with a leading underscore would be lost.
    named = {f"throttle_key{i}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for i, k in enumerate(keys)}
    rows = alerts.filter(F.col(ts).isNotNull()).withWatermark(ts, watermark).withColumns(named).withColumn("throttle_us", F.unix_micros(ts))
    return rows.groupBy(*named).transformWithStateInPandas(_Throttle(columns, seconds * 1_000_000), alerts.schema, "Append", "EventTime")
