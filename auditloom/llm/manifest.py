"""Merkle manifest of a data set: hash trees per group and over the groups, with a proof for every row.

A row is a leaf, the digest of its fields. The leaves of a group, in order, are folded in runs of three until one
node, the group's root, remains; the roots of the groups, in order, are folded likewise into the root of all.

Ranks come from a range partitioning: a row is ordered only within its range, and one small table says how many
rows of a group lie in earlier ranges, so a group may hold any share of the rows. The digits of a rank (base three)
become columns. Blocks of ``3 ** DIGITS`` ranks meet in one shuffle; within it the digits are grouped away one after
another, each step nesting the structs below it. Blocks are the leaves of the next round. On the way back one
nested transform and one explode a round turn a block's tree into its leaves' proofs: no node is joined to
another, and no row ever holds more than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

FAN = 3
#: Rank digits grouped away within one block: a block holds up to FAN ** DIGITS nodes.
DIGITS = 6


def field(value: Column) -> Column:
    """A value so that no two lists of values read alike: `-` for null, else bytes, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(values: list[Column]) -> Column:
    """The leaf of a row: sha-256 of its fields."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """sha-256 of all digests of a proof, leaf level first, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rank`` (from 0) and ``n`` of each row within ``__g``."""
    dealt = rows.withColumn("__row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange("__g", *order, "__row").withColumn("__range", F.spark_partition_id())
    dealt = cut_lineage(dealt, "manifest")
    # One row per group and range: at most as many rows of a group as there are ranges.
    in_order = W.partitionBy("__g").orderBy("__range")
    parts = dealt.groupBy("__g", "__range").agg(F.count(F.lit(1)).alias("__here"))
    parts = parts.select(
        "__g", "__range", F.coalesce(F.sum("__here").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__here").over(W.partitionBy("__g")).alias("n"),
    )
    at = F.row_number().over(W.partitionBy("__g", "__range").orderBy(*order, "__row"))
    return dealt.withColumn("__at", at).join(parts, ["__g", "__range"]).withColumn("rank", F.col("__before") + F.col("__at") - 1)


def _rollup(nodes: DataFrame, digits: int) -> DataFrame:
    """(__g, n, block, node) from (__g, n, rank, leaf): the nested tree of each block.

    ``n`` is the group's number of nodes. A level is hashed while the group has several nodes there; a group that is
    down to one passes it on as it is.
    """
    rank = F.col("rank")
    level = [f"d{k}" for k in range(digits)]
    rows = nodes.select(
        "__g", "n", F.floor(rank / FAN**digits).alias("block"),
        *[F.pmod(F.floor(rank / FAN**k), F.lit(FAN)).cast("int").alias(d) for k, d in enumerate(level)],
        F.col("leaf").alias("node"),
    ).repartition("__g", "block")
    for k, digit in enumerate(level):
        keys = ["__g", "n", "block", *level[k + 1 :]]
        rows = rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col(digit).alias("d"), "node")).alias("kids"))
        kids = F.transform(F.array_sort("kids", lambda a, b: a["d"] - b["d"]), lambda x: x["node"])
        hashed = F.col("n") > FAN**k
        rows = rows.select(*keys, hashed.alias("hashed"), kids.alias("kids"))
        digest = F.when(F.col("hashed"), F.sha2(F.array_join(F.transform("kids", lambda x: x["hash"]), ""), 256)).otherwise(F.col("kids")[0]["hash"])
        rows = rows.select(*keys, F.struct(digest.alias("hash"), "hashed", "kids").alias("node"))
    return rows


def _levels(nodes: DataFrame, digits: int) -> list[DataFrame]:
    """Rounds of blocks, from the leaves to the round in which every group is one block."""
    out = []
    while True:
        blocks = cut_lineage(_rollup(nodes, digits), "manifest")
        out.append(blocks)
        over = F.ceil(F.col("n") / FAN**digits).cast("long")
        if (blocks.agg(F.max(over)).first()[0] or 0) <= 1:
            return out
        leaf = F.struct(F.col("node.hash").alias("hash"), F.struct("block").alias("row"))
        nodes = blocks.select("__g", over.alias("n"), F.col("block").alias("rank"), leaf.alias("leaf"))


def _paths(node: Column, path: Column, digits: int) -> Column:
    """Every leaf below a node with the steps from it upwards: an array of (hash, row, path)."""
    if not digits:
        return F.array(F.struct(node["hash"].alias("hash"), node["row"].alias("row"), path.alias("path")))
    hashes = lambda part: F.array_join(F.transform(part, lambda x: x["hash"]), "")
    step = lambda i: F.array(F.struct(
        hashes(F.slice(node["kids"], F.lit(1), i)).alias("before"), hashes(F.slice(node["kids"], i + 2, F.lit(FAN))).alias("after"),
    ))
    return F.flatten(F.transform(
        node["kids"], lambda kid, i: _paths(kid, F.when(node["hashed"], F.concat(step(i), path)).otherwise(path), digits - 1),
    ))


def _descend(levels: list[DataFrame], tops: DataFrame, digits: int) -> DataFrame:
    """(__g, leaf, row, up) of every leaf from (__g, up) of every group's root; up holds path and what else comes down."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for i, blocks in reversed(list(enumerate(levels))):
        both = blocks.select("__g", "block", "node").unionByName(above.select("__g", "block", "up"), allowMissingColumns=True)
        met = both.groupBy("__g", "block").agg(F.first("node", ignorenulls=True).alias("node"), F.first("up", ignorenulls=True).alias("up"))
        found = met.select("__g", "up", F.explode(_paths(F.col("node"), F.col("up.path"), digits)).alias("x"))
        found = found.select("__g", F.col("x.hash").alias("leaf"), F.col("x.row").alias("row"), F.col("up").withField("path", F.col("x.path")).alias("up"))
        if i:
            above = found.select("__g", F.col("row.block").alias("block"), "up")
    return found


def manifest(docs: DataFrame, leaf: Column, group: str, order: str, keep: dict[str, Column], digits: int = DIGITS) -> DataFrame:
    """The ``keep`` columns of every row of ``docs``, with leaf, subroot, root and proof.

    ``leaf`` gives a row's digest, ``group`` (a string; null is a group, and the first) its tree, ``order`` its place in
    it: nulls first, equal ones by their leaf. Repeated rows are leaves of their own. ``proof`` is an array of
    (before, after): the digests left and right of the path, for each level up to the root; both are empty in a run
    of one. Columns of ``docs`` not named are ignored, so their names cannot clash. An empty table has no rows and no root.
    """
    rows = docs.select(
        F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group))).alias("__g"),
        F.col(order).alias("__order"), leaf.alias("__hash"), F.struct(*[c.alias(n) for n, c in keep.items()]).alias("__keep"),
    )
    node = F.struct(F.col("__hash").alias("hash"), F.col("__keep").alias("row"))
    levels = _levels(_ranked(rows, ["__order", "__hash"]).select("__g", "n", "rank", node.alias("leaf")), digits)

    groups = levels[-1].select(F.lit("").alias("__g"), F.col("__g").alias("__group"), F.col("node.hash").alias("__hash"))
    node = F.struct(F.col("__hash").alias("hash"), F.struct(F.col("__group").alias("g")).alias("row"))
    over = _levels(_ranked(groups, ["__group"]).select("__g", "n", "rank", node.alias("leaf")), digits)

    no_steps = F.array().cast("array<struct<before:string,after:string>>")
    top = over[-1].select("__g", F.struct(F.col("node.hash").alias("root"), no_steps.alias("path")).alias("up"))
    tops = _descend(over, top, digits).select(F.col("row.g").alias("__g"), F.col("up").withField("subroot", F.col("leaf")).alias("up"))
    found = _descend(levels, tops, digits)
    return found.select("row.*", "leaf", "up.subroot", "up.root", F.col("up.path").alias("proof"))


def document_manifest(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The manifest of ``documents`` by source, with what a proof says of each row after tampering.

    Where 2 divides the CRC-32 of the id in decimal, the text loses its line feeds; a null id is left alone. Returns
    doc_id, leaf, subroot, root, proof_sha256, folded_root (from the row as tampered with) and verified.
    """
    fields = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains(F.coalesce("text", F.lit("")), F.lit("\n"))
    seen = F.when(hit, row_digest(fields(F.replace("text", F.lit("\n"), F.lit("")))))
    rows = manifest(docs, row_digest(fields(F.col("text"))), "source", "doc_id", {"doc_id": F.col("doc_id"), "seen": seen}, digits)
    rows = rows.withColumn("folded_root", fold(F.coalesce("seen", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
