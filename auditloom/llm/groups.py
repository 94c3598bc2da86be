"""Connected groups of a graph held as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import cut_counted, cut_lineage


class Forest:
    """Union-find over the places of a small array."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)


def star_edges(rows: DataFrame, key: list[str], node: str) -> DataFrame:
    """(u, v) from every node to the least node with the same key, each pair once. One row per node and key at most.

    The least node of a key is a map-side aggregate, and a hot key of the join can be split, so no group is
    gathered anywhere.
    """
    least = rows.groupBy(*key).agg(F.min(node).alias("v"), F.max(node).alias("most")).filter("v < most").drop("most")
    return rows.join(least, key).filter(F.col(node) > F.col("v")).select(F.col(node).alias("u"), "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected group, for every node of ``edges`` (u, v).

    Alternates two rewirings, each a group-by and a join: neighbours above a node are hung on its least
    neighbour, then a node and its neighbours below on that one. Rounds are logarithmic in the number of
    nodes, hubs and chains included; each is written to the shared folder. Self loops and repeated edges
    do no harm, an empty table gives an empty one.
    """
    edges = cut_lineage(_canonical(edges), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = _canonical(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = cut_lineage(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges, n = cut_counted(_canonical(hung).withColumn("h", F.xxhash64("u", "v")), "edges")
        state = (n, edges.agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0])
        edges = edges.drop("h")
        if state == seen or n == 0:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _canonical(edges: DataFrame) -> DataFrame:
    """Larger node first, each edge once, no self loops."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def block_pairs(rows: DataFrame, group: str, size: str, node: str, block: int) -> DataFrame:
    """``rows`` dealt for pairwise work within groups: adds shard and side.

    A group of at most ``block`` rows is one piece. A larger one is cut into blocks by the node's hash, and
    every two blocks (and every block alone) are a piece, so that each pair of the group meets: exactly one
    piece has it, if pairs within a block count in the block's own piece only. A row goes to as many pieces as its group
    has blocks; nothing is gathered beyond two blocks.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64(node, F.lit(7)), n)
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    rows = rows.withColumn("__piece", F.explode(F.when(n <= 1, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(pieces)))
    return rows.withColumn("piece_i", F.col("__piece.i")).withColumn("piece_j", F.col("__piece.j")).withColumn("own", F.when(n <= 1, F.lit(0)).otherwise(own).cast("long")).drop("__piece")
