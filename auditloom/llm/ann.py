"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Every vector is indexed under a number of single random projections, each a sorted array. A query's window
on each array is centred on the query's own projection, so buckets have no borders; widening all windows by a
factor (virtual rehashing) needs no other index. A vector that falls into enough of a query's windows is
verified by its exact similarity. The index is dealt into blocks, and each block serves the queries block
by block: a stated query set against all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_counted

#: Projections, and the least share of them in which a candidate collides with the query.
PROJECTIONS, SHARE = 128, 0.7
#: First half width of a window, in standard deviations of a unit vector's projection, and the widening factor.
WIDTH, FACTOR = 1.0, 1.06
#: Vectors of a block, and queries of a block.
ROWS, QUERIES = 8192, 1024
#: Candidates beyond k that a block verifies for a query before it stops widening.
EXTRA = 400
SEED = 29


def usable(vector: Column) -> Column:
    """Has the vector components, none of them null or not finite, and not all zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same two vectors give the same number wherever they stand."""
    dot = np.add.reduce(a * b, axis=1)
    return dot / (np.sqrt(np.add.reduce(a * a, axis=1)) * np.sqrt(np.add.reduce(b * b, axis=1)))


class Index:
    """Sorted projection arrays of the unit vectors of one block."""

    def __init__(self, vectors: np.ndarray, projections: int, seed: int):
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        self.axes /= np.linalg.norm(self.axes, axis=0)
        values = self.unit @ self.axes
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(values, axis=0).T.copy()

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window begins and ends in each array; ``at`` holds queries' projections by array."""
        pairs = [(np.searchsorted(s, x - half), np.searchsorted(s, x + half, "right")) for s, x in zip(self.sorted, at)]
        return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def candidates(self, queries: np.ndarray, need: int, least: int, width: float, factor: float):
        """For each unit query, rows that collide with it in ``least`` arrays at the first width with ``need`` of them."""
        at = (queries @ self.axes).T
        n, levels = self.sorted.shape[1], []
        need, half = min(need, n), width / np.sqrt(queries.shape[1])
        for q in range(len(queries)):
            count, level, lo, hi = np.zeros(n, np.int64), 0, None, None
            while True:
                if level == len(levels):
                    levels.append(self.windows(at, half))
                    half *= factor
                new_lo, new_hi = levels[level][0][:, q], levels[level][1][:, q]
                level += 1
                if lo is None:
                    parts = [o[a:b] for o, a, b in zip(self.order, new_lo, new_hi)]
                else:  # only what the wider windows add is counted
                    parts = [o[a:b] for o, a, b in zip(self.order, new_lo, lo)] + [o[a:b] for o, a, b in zip(self.order, hi, new_hi)]
                count += np.bincount(np.concatenate(parts), minlength=n)
                lo, hi = new_lo, new_hi
                found = np.flatnonzero(count >= least)
                if len(found) >= need or (hi - lo).min() == n:
                    yield found
                    break


def _search(k: int, projections: int, share: float, width: float, factor: float, extra: int, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        is_query = rows["is_query"].to_numpy()
        base, asked = rows[~is_query].sort_values("vec_id"), rows[is_query]
        if len(base) and len(asked):
            vectors, ids = np.stack(base["vector"].to_numpy()), base["vec_id"].to_numpy()
            queries = np.stack(asked["vector"].to_numpy())
            index = Index(vectors, projections, seed)
            unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
            near = index.candidates(unit, k + 1 + extra, max(1, round(share * projections)), width, factor)
            for q, v, found in zip(asked["vec_id"], queries, near):
                found = found[ids[found] != q]
                score = cosine(np.broadcast_to(v, (len(found), len(v))), vectors[found])
                best = np.lexsort((ids[found], -score))[:k]
                out += zip([q] * len(best), ids[found[best]], score[best], [len(found)] * len(best))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "verified"])

    return run


def nearest(
    rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", projections: int = PROJECTIONS, share: float = SHARE,
    width: float = WIDTH, factor: float = FACTOR, extra: int = EXTRA, block_rows: int = ROWS, block_queries: int = QUERIES, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each query row, by cosine in double precision.

    Every usable row is a candidate except the query's own id; ties go to the smaller id. Null ids, and vectors that are null,
    zero, or hold null or non-finite components take no part; nor do vectors of another length than the most common one.
    Repeated rows of one id count once: the greatest vector stays. An empty table, or no query, gives an empty result.
    """
    good = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    good = good.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    good = good.groupBy("vec_id").agg(F.max("vector").alias("vector"), F.max("is_query").alias("is_query"))
    good, n = cut_counted(good, "vectors")
    length = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.filter(F.size("vector") == (length["n"] if length else 0))
    blocks = max(1, -(-n // block_rows))
    queries = max(1, -(-good.filter("is_query").count() // block_queries))
    base = good.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(False).alias("is_query"))
    base = base.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(queries - 1).cast("long"))))
    asked = good.filter("is_query").select("vec_id", "vector", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(queries)).alias("part"), F.lit(True).alias("is_query"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    run = _search(k, projections, share, width, factor, extra, seed)
    id_kind = rows.schema[vec_id].dataType.simpleString()
    found = base.unionByName(asked).groupBy("block", "part").applyInPandas(run, f"query_id {id_kind}, vec_id {id_kind}, score double, verified long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
