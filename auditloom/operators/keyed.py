"""Per-key selection and per-key history that survive a hot key.

"First row per key" is an aggregate, not a window: ``min(struct(...))`` combines
on the map side, so a key holding a third of all rows costs one row per task.
"Previous value per key" splits every key into time chunks; only one summary
row per chunk is ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The lowest row per key by ``order``; ties fall to the row's other columns."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(
        *[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest]
    )
    picked = df.groupBy(*keys).agg(F.min(ordered).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL is a value like any other; ``right`` gives its other columns."""
    named = right.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return left.join(named, same, how).drop(*[f"_key{i}" for i in range(len(keys))])


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column,
    name: str = "prev", seed: Column | None = None,
) -> DataFrame:
    """Add the last non-NULL ``value`` of the same key before each row.

    ``chunk`` is a non-decreasing function of the order (a day, an hour, a
    sequence range) that bounds how many rows of one key are sorted together.
    """
    work = df.withColumn("_chunk", chunk).withColumn("_value", value)
    ordering = F.struct(*order)
    summary = work.groupBy(*keys, "_chunk").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), ordering)).alias("_last")
    )
    per_key = Window.partitionBy(*keys).orderBy("_chunk")
    carried = summary.select(
        *keys, "_chunk",
        F.last("_last", ignorenulls=True)
        .over(per_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    joined = join_keys(work, carried, [*keys, "_chunk"])
    prev = F.coalesce(
        F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)),
        F.col("_carried"),
    )
    if seed is not None:
        prev = F.coalesce(prev, seed)
    return joined.withColumn(name, prev).drop("_chunk", "_value", "_carried")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, amount: Column, name: str
) -> DataFrame:
    """Running sum per key up to and including each row, chunked like carry_forward."""
    work = df.withColumn("_chunk", chunk).withColumn("_amount", amount)
    sums = work.groupBy(*keys, "_chunk").agg(F.sum("_amount").alias("_sum"))
    per_key = Window.partitionBy(*keys).orderBy("_chunk")
    before = sums.select(
        *keys, "_chunk",
        F.coalesce(
            F.sum("_sum").over(per_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        join_keys(work, before, [*keys, "_chunk"])
        .withColumn(
            name,
            F.col("_before")
            + F.sum("_amount").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .drop("_chunk", "_amount", "_before")
    )


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column, name: str
) -> DataFrame:
    """Greatest value of the same key before each row, chunked like carry_forward; NULL for a key's first row."""
    work = df.withColumn("_chunk", chunk).withColumn("_value", value)
    tops = work.groupBy(*keys, "_chunk").agg(F.max("_value").alias("_top"))
    per_key = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*keys, "_chunk", F.max("_top").over(per_key).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = join_keys(work, before, [*keys, "_chunk"])
    return joined.withColumn(name, F.greatest(F.max("_value").over(inside), F.col("_before"))).drop("_chunk", "_value", "_before")


def neighbours(
    df: DataFrame, keys: Sequence[str], seq: str, before: int, after: int, block: int = 4096
) -> tuple[DataFrame, Column, Window]:
    """Rows with copies at block edges, an ownership flag and the window to use.

    For windows of at most ``before``/``after`` rows over a gap-free ``seq``:
    long sequences are cut into blocks, and rows near an edge are copied into
    the neighbouring block. Keep only owned rows after the window.
    """
    s = F.col(seq)
    lo, hi = F.floor((s - after) / block), F.floor((s + before) / block)
    spread = df.withColumn("_block", F.explode(F.sequence(lo, hi)))
    owned = F.col("_block") == F.floor(s / block)
    return spread, owned, Window.partitionBy(*keys, "_block").orderBy(seq)
