"""State invariants over snapshots, balances and call traces (batch)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .keyed import carry_forward, neighbours, running_max

SINKS = ("stdout", "file", "webhook", "slack", "discord", "pagerduty", "prometheus")


def check_invariants(df: DataFrame, keys: Sequence[str], invariants: dict[str, Column], state: Sequence[str]) -> DataFrame:
    """One row per (row, invariant): holds, violated or undecidable, with the observed state."""
    observed = F.to_json(F.struct(*state), {"ignoreNullFields": "false"})
    checks = F.array(*[
        F.struct(
            F.lit(name).alias("invariant"),
            F.when(expr.isNull(), "undecidable").when(expr, "holds").otherwise("violated").alias("outcome"),
        )
        for name, expr in invariants.items()
    ])
    return df.select(*keys, observed.alias("state"), F.inline(checks))


def bind_invariants(df: DataFrame, invariants: dict[str, Sequence[str]]) -> None:
    """Fail once, naming every variable no column provides."""
    have = set(df.columns)
    missing = {n: sorted(set(used) - have) for n, used in invariants.items() if set(used) - have}
    if missing:
        detail = "; ".join(f"{n}: {', '.join(m)}" for n, m in sorted(missing.items()))
        raise ValueError(f"unbound variables - {detail}; available: {', '.join(sorted(have))}")


def monotonic(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column, genesis: Column | None = None
) -> DataFrame:
    """Rows whose value is below the previous readable one; unreadable values are skipped."""
    walked = carry_forward(df, keys, order, chunk, F.col(value), "prev", genesis)
    return walked.filter(F.col(value) < F.col("prev"))


def authorised_change(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], guarded: str, chunk: Column,
    owner: str = "owner", caller: str = "caller", fn: str = "fn",
) -> DataFrame:
    """The owner changed through the guarded function by someone who was not the owner."""
    walked = carry_forward(df, keys, order, chunk, F.col(owner), "prev_owner")
    return walked.filter(
        (F.col(fn) == guarded) & (F.col(owner) != F.col("prev_owner")) & (F.col(caller) != F.col("prev_owner"))
    )


def owner_constant(df: DataFrame, keys: Sequence[str], order: Sequence[str], owner: str = "owner", expected: Column | None = None) -> DataFrame:
    """Rows whose owner is not the first one seen (or a given one)."""
    if expected is not None:
        return df.withColumn("genesis", expected).filter(F.col(owner) != F.col("genesis"))
    first = df.groupBy(*keys).agg(
        F.min_by(owner, F.when(F.col(owner).isNotNull(), F.struct(*order))).alias("genesis")
    )
    return df.join(first, list(keys)).filter(F.col(owner) != F.col("genesis"))


def conservation(balances: DataFrame, totals: DataFrame, key: str, amount: str, total: str) -> DataFrame:
    """Entities whose parts do not add up to the stated total; unread parts are skipped."""
    summed = balances.filter(F.col(amount).isNotNull()).groupBy(key).agg(F.sum(amount).alias("summed"))
    return totals.filter(F.col(total).isNotNull()).join(summed, key).filter(F.col("summed") != F.col(total)).select(
        key, "summed", F.col(total).alias("stated")
    )


def cross_phase(snapshots: DataFrame, before: str, after: str, op: str) -> DataFrame:
    """The same variable of an entity in two phases; rows where ``after op before`` fails."""
    side = F.when(F.col("phase").isin(before, after), F.col("value"))
    pivoted = snapshots.filter(F.col("phase").isin(before, after)).groupBy("entity", "layer", "var").agg(
        F.max(F.when(F.col("phase") == before, side)).alias("before"),
        F.max(F.when(F.col("phase") == after, side)).alias("after"),
    )
    a, b = F.col("after"), F.col("before")
    holds = {"==": a == b, ">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b, "!=": a != b}[op]
    return pivoted.filter(~holds)


def privileged_unguarded(mutations: DataFrame) -> DataFrame:
    """Privileged mutations with no guard."""
    return mutations.filter(F.size("guards") == 0).withColumns({
        "invariant_id": F.lit("unauthorized_privileged_mutation"), "severity": F.lit("Critical"),
    })


def call_frames(events: DataFrame, block: int = 100_000) -> DataFrame:
    """(trace_id, address, b_seq, e_seq, reverted) of every call that ends, from ``events(trace_id, seq, kind, address, reverted)``.

    Brackets are matched in two steps. Inside a block of ``block`` sequence numbers, begins and ends of one level
    alternate, so a begin closes with the next row of its level. What a block leaves open are ends of earlier begins and begins of
    later ends; the levels of these are set off by the blocks before (one number a block), and then they
    alternate too: at most one end and one begin a block and level. Ends without a begin and begins without an end are no frames.
    """
    step = F.when(F.col("kind") == "begin", 1).otherwise(-1)
    rows = events.filter(F.col("kind").isin("begin", "end")).select("trace_id", "seq", "kind", "address", "reverted", F.floor(F.col("seq") / block).alias("block"))
    inside = Window.partitionBy("trace_id", "block")
    after = F.sum(step).over(inside.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("level", after + (F.col("kind") == "end").cast("int"))
    alone = Window.partitionBy("trace_id", "block", "level").orderBy("seq")
    rows = cut_lineage(_closed(rows, alone), "brackets")
    left = rows.filter("open")
    offsets = left.groupBy("trace_id", "block").agg(F.sum(step).alias("net"))
    earlier = Window.partitionBy("trace_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("trace_id", "block", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("offset"))
    left = left.drop("e_seq", "ended", "open").join(offsets, ["trace_id", "block"]).withColumn("level", F.col("level") + F.col("offset"))
    across = _closed(left, Window.partitionBy("trace_id", "level").orderBy("seq"))
    frames = [r.filter("e_seq is not null").select("trace_id", "address", F.col("seq").alias("b_seq"), "e_seq", F.col("ended").alias("reverted")) for r in (rows, across)]
    return frames[0].unionByName(frames[1])


def _closed(rows: DataFrame, level: Window) -> DataFrame:
    """Begins with the end that follows on their level, and which rows stay open."""
    follows = F.lead(F.struct("kind", "seq", "reverted")).over(level)
    before = F.lag("kind").over(level)
    begin = F.col("kind") == "begin"
    rows = rows.withColumn("_next", follows).withColumn("_before", before)
    ends = begin & (F.col("_next.kind") == "end")
    return rows.select(
        *[c for c in rows.columns if c not in ("_next", "_before")],
        F.when(ends, F.col("_next.seq")).alias("e_seq"), F.when(ends, F.col("_next.reverted")).alias("ended"),
        F.when(begin, ~F.coalesce(ends, F.lit(False))).otherwise(F.coalesce(F.col("_before") == "end", F.lit(True))).alias("open"),
    ).filter(begin | F.col("open"))


def reentrant_traces(events: DataFrame, block: int = 100_000) -> DataFrame:
    """Traces where a frame re-enters an open address, succeeds, and the address is written later.

    Frames nest, so an address is open at a begin if a frame of it that began before ends after: a running
    maximum of ends, by blocks. The events are read twice, for frames and for writes.
    """
    frames = cut_lineage(call_frames(events, block), "frames")
    seen = running_max(frames, ["trace_id", "address"], ["b_seq"], F.floor(F.col("b_seq") / block), F.col("e_seq"), "open_until")
    reentries = seen.filter((F.col("open_until") > F.col("b_seq")) & ~F.col("reverted")).groupBy("trace_id", "address").agg(
        F.min("e_seq").alias("first_end")
    )
    writes = events.filter(F.col("kind") == "write").groupBy("trace_id", "address").agg(F.max("seq").alias("last_write"))
    return reentries.join(writes, ["trace_id", "address"]).filter(F.col("last_write") >= F.col("first_end")).select(
        "trace_id", "address", "first_end", "last_write"
    )


def followed_by_within(events: DataFrame, keys: Sequence[str], seq: str, a: Column, b: Column, n: int) -> DataFrame:
    """Rows A with a row B among the next n rows of the same gap-free sequence."""
    marked = events.withColumn("_a", a).withColumn("_b", b)
    spread, owned, w = neighbours(marked, keys, seq, 0, n)
    near = F.max(F.col("_b").cast("int")).over(w.rowsBetween(1, n))
    return spread.withColumn("_near", near).filter(owned & F.col("_a") & (F.col("_near") == 1)).select(*events.columns)


def not_preceded_by(events: DataFrame, keys: Sequence[str], seq: str, a: Column, c: Column) -> DataFrame:
    """Rows A whose direct predecessor exists and is not C."""
    marked = events.withColumn("_a", a).withColumn("_c", c)
    spread, owned, w = neighbours(marked, keys, seq, 1, 0)
    return spread.withColumn("_prev", F.lag("_c").over(w)).filter(
        owned & F.col("_a") & ~F.col("_prev")
    ).select(*events.columns)


def invariants_for(config: DataFrame, contracts: DataFrame, chain: str, parts: int = 64) -> DataFrame:
    """The configured invariants of a chain on its contracts.

    The result holds every pair of a target, so a target's invariants are dealt over ``parts`` and its contracts go to each:
    few targets do not mean few tasks. The number of tasks is given, as both sides are small beside the result.
    """
    rows = config.filter(F.col("chain") == chain)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))
    others = contracts.filter(F.col("chain") == chain).drop("chain").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = ["target", "_part"]
    return rows.repartition(parts, *key).join(others.repartition(parts, *key), key).drop("_part")


def validate_invariant_config(chains: DataFrame, invariants: DataFrame, sinks: DataFrame) -> DataFrame:
    """Every problem of a configuration: duplicates, unknown chains, bad sinks."""
    dup = lambda df, col, problem: df.groupBy(F.col(col).alias("subject")).count().filter("count > 1").select(
        F.lit(problem).alias("problem"), "subject"
    )
    unknown = invariants.select("name", "chain").join(
        chains.select(F.col("id").alias("chain")), "chain", "left_anti"
    ).select(F.lit("unknown chain").alias("problem"), F.concat_ws("->", "name", "chain").alias("subject"))
    bad = sinks.filter(~F.col("type").isin(*SINKS)).select(F.lit("bad sink").alias("problem"), F.col("type").alias("subject"))
    return dup(chains, "id", "duplicate chain").unionByName(dup(invariants, "name", "duplicate invariant")).unionByName(unknown).unionByName(bad)
