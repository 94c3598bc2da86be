"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies, its source's target over its source's size. Whole
copies are certain; the fraction left is an inclusion probability, and documents are taken in the order
of random odds over inclusion odds until the source's remaining words are reached. No window runs over a
source: its few large documents (a bounded number) are fitted in one fold, all others through sums per
slice of the order, so that only the slice holding the boundary is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .base import text_key

WORD = r"[^\x20\x09-\x0D]+"
#: A document is large if it holds more than one part in so many of its source's words.
LARGE = 256
#: Slices of the order within a source.
SLICES = 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), most: float = 2.0) -> DataFrame:
    """Target words per source from (source, source_size): one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes. No target
    passes ``most`` times its source's size: what is above is shared again by weight. Filling stops at one
    level for all, so it is found from sums over the sources ordered by cap over weight. The table of
    sources is the output of a group-by; its windows see one small row per source.
    """
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), at % len(weights))
    full = W.orderBy(F.col("cap") / F.col("weight"), F.col("at")).rowsBetween(W.unboundedPreceding, -1)
    rows = (
        sizes.select("source", "source_size", at.alias("at"), turn.alias("weight"))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
    )
    # Were all sources before this one full, the rest would share at this level.
    level = (F.col("total") - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "at", "level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(reached["level"], F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _order(doc_id: str, seed: int) -> Column:
    """A document's random number in (0, 1), from the seed, its id and its text."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col("__key")), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def _odds(p: Column) -> Column:
    return p / (F.lit(1.0) - p)


def _first_fit(items: Column, words: Column) -> Column:
    """In the given order, an item is kept if it does not pass the words still to fill."""
    start = F.struct(words.alias("left"), F.filter(items, lambda _: F.lit(False)).alias("kept"))
    return F.aggregate(
        items, start,
        lambda acc, x: F.when(
            x["words"] <= acc["left"],
            F.struct((acc["left"] - x["words"]).alias("left"), F.concat(acc["kept"], F.array(x)).alias("kept")),
        ).otherwise(acc),
    )


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), most: float = 2.0, seed: int = 0) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, copies and taken (copies times size).

    A null text has size 0, and a row of size 0 is taken 0 times; a null source is a source. The random
    order comes from the seed, the id and the text, so reruns agree; rows equal in source, id and text share
    their fate. Columns of ``docs`` with the result's names are replaced. An empty table gives an empty one.
    """
    base = (
        docs.drop("size", "source_size", "target", "copies", "taken")
        .withColumn("size", word_count(F.col("text"))).withColumn("__key", text_key())
        .withColumn("__u", _order("doc_id", seed))
    )
    narrow = cut_lineage(base.select("source", "doc_id", "__key", "__u", "size"), "mix")
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = (
        targets.withColumn("__sure", F.floor(each)).withColumn("__part", each - F.floor(each))
        .withColumn("__want", F.col("target") - F.col("__sure") * F.col("source_size"))
        .withColumnRenamed("source", "__source")
    )
    plan = cut_lineage(plan, "mix")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    part = F.least(F.greatest(F.col("__part"), F.lit(1e-12)), F.lit(1 - 1e-12))
    units = (
        narrow.filter("size > 0").groupBy("source", "doc_id", "__key", "__u", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("words"))
        .join(plan, same("source", "__source"))
        .withColumn("rank", _odds(F.col("__u")) / _odds(part))
        .withColumn("__large", F.col("words") * LARGE > F.col("source_size"))
    )
    units = cut_lineage(units.select("source", "doc_id", "__key", "words", "rank", "__large", "__want", F.floor(F.col("__u") * SLICES).alias("__slice")), "mix")

    fitted = (
        units.filter("__large").groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "__key", "words"))).alias("items"), F.first("__want").alias("__want"))
        .select("source", "__want", _first_fit(F.col("items"), F.col("__want")).alias("fit"))
    )
    fitted = cut_lineage(fitted.select("source", (F.col("__want") - F.col("fit.left")).alias("__by_large"), "fit.kept"), "mix")
    up_to = W.partitionBy("source").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    slices = (
        units.filter("not __large").groupBy("source", "__slice").agg(F.sum("words").alias("__in"), F.first("__want").alias("__want"))
        .withColumn("__before", F.coalesce(F.sum("__in").over(up_to), F.lit(0)))
        .join(fitted.select(F.col("source").alias("__source"), "__by_large"), same("source", "__source"), "left").drop("__source")
        .withColumn("__rest", F.col("__want") - F.coalesce("__by_large", F.lit(0.0)))
        # The last slice that begins below the rest is the one that the rest ends in.
        .filter(F.col("__before") < F.col("__rest"))
        .groupBy("source").agg(F.max(F.struct("__slice", "__before", "__rest")).alias("edge"))
        .select(F.col("source").alias("__source"), "edge.*")
    )
    slices = cut_lineage(slices.withColumnRenamed("__slice", "__edge"), "mix")
    within = W.partitionBy("source").orderBy("rank", "doc_id", "__key").rowsBetween(W.unboundedPreceding, -1)
    edge = (
        units.filter("not __large").join(slices, same("source", "__source") & (F.col("__slice") == F.col("__edge")))
        .withColumn("__so_far", F.col("__before") + F.coalesce(F.sum("words").over(within), F.lit(0)))
        .filter(F.col("__so_far") + F.col("words") / 2 < F.col("__rest")).select("source", "doc_id", "__key")
    )
    kept = edge.unionByName(fitted.select("source", F.explode("kept").alias("x")).select("source", "x.doc_id", "x.__key"))
    kept = kept.select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), F.col("__key").alias("__k"), F.lit(True).alias("__kept"))

    rows = (
        base.join(plan.select("__source", "source_size", "target", "__sure"), same("source", "__source")).drop("__source")
        .join(slices.select("__source", "__edge"), same("source", "__source"), "left").drop("__source")
        .join(kept, same("source", "__s") & same("doc_id", "__d") & same("__key", "__k"), "left")
    )
    # Large documents are in `kept` or not taken; the edge slice is decided there too.
    before_edge = F.floor(F.col("__u") * SLICES) < F.coalesce(F.col("__edge"), F.lit(-1))
    more = F.coalesce(F.col("__kept"), before_edge & ~F.col("__is_large"), F.lit(False)).cast("long")
    units_large = units.filter("__large").select(F.col("source").alias("__s2"), F.col("doc_id").alias("__d2"), F.col("__key").alias("__k2"), F.lit(True).alias("__is_large"))
    rows = rows.join(units_large, same("source", "__s2") & same("doc_id", "__d2") & same("__key", "__k2"), "left")
    rows = rows.withColumn("__is_large", F.coalesce("__is_large", F.lit(False)))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("__sure") + more).otherwise(F.lit(0)).cast("long"))
    extra = [c for c in rows.columns if c.startswith("__") and c not in docs.columns]
    return rows.drop(*extra).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``docs``."""
    rows = mix(docs.select("*", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")), **how)
    return rows.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("__row.*")
