"""N-gram Jaccard self-join: MinHash banding for candidates, full n-gram sets for the verdict.

Documents with equal n-gram sets are one class from the start; only classes are joined. Candidates share
a band of the signature. Their connected groups bring each class's n-gram set to one place (large groups to
blocks), where every two classes with a common band are compared on the full sets. Tasks return links as
counts and as a spanning forest, never as all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_counted, cut_lineage
from .groups import Forest, block_pairs, components, star_edges
from .kernel import Grams, U, as_bytes, mix, range_hashes, slices, word_spans

N = 5
SIMILARITY = 0.8
#: Least chance that a pair of just that similarity shares a band.
RECALL = 0.9999
#: Classes in one block of a large candidate group; rows of small groups in one task.
BLOCK, TASK = 256, 400
_SEED = U(0x2545F4914F6CDD1D)


def band_layout(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = 200) -> tuple[int, int]:
    """(bands, rows a band): the most rows a band, so the fewest false candidates, that reach the recall with that many hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def gram_sets(texts: pa.Array, n: int):
    """Per slice of texts: (from, to, hashes, first): each text's distinct n-gram hashes, ascending.

    A text of fewer words has one gram of all of them; one without words has none.
    """
    for a, b in slices(texts):
        data, offsets = as_bytes(texts.slice(a, b - a))
        starts, ends, first = word_spans(data, offsets)
        grams = Grams(range_hashes(data, starts, ends))
        words = np.diff(first)
        count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
        doc = np.repeat(np.arange(b - a), count)
        at = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.repeat(first[:-1], count)
        hashes = grams.runs(at, at + np.repeat(np.minimum(words, n), count))
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        hashes, doc = hashes[new], doc[new]
        yield a, b, hashes, np.searchsorted(doc, np.arange(b - a + 1))


def signatures(hashes: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands): hash of each band of MinHash values; texts without grams have zeros."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, bands), U)
    if not len(full):
        return out
    at = first[:-1][full]
    scratch = np.empty_like(hashes)
    factors = mix(np.arange(1, bands * rows + 1, dtype=U) * _SEED) | U(1)
    for b in range(bands):
        band = np.full(len(full), b + 1, U)
        for f in factors[b * rows : (b + 1) * rows]:
            # The high half is the permuted value; the low half only breaks ties.
            band = mix(band * _SEED + np.minimum.reduceat(np.multiply(hashes, f, out=scratch), at))
        out[full, b] = band
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("dk"))


def _signature_rows(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, dk, set_a, set_b, grams, bands) of each row; set_a and set_b stand for the whole set."""

    def batches(it):
        names = ["doc_id", "dk", "set_a", "set_b", "grams", "bands"]
        for batch in it:
            for a, b, hashes, first in gram_sets(batch.column(1), n):
                count = np.diff(first)
                total = [np.concatenate((np.zeros(1, U), np.cumsum(x)))[first] for x in (mix(hashes), mix(hashes ^ _SEED))]
                total = [(t[1:] - t[:-1]) for t in total]
                sig = signatures(hashes, first, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)), pa.array(sig.reshape(-1).view(np.int64)))
                cols = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *(pa.array(t.view(np.int64)) for t in total), pa.array(count), lists]
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(batches, f"doc_id {kind}, dk long, set_a long, set_b long, grams long, bands array<long>")


def _set_rows(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``wanted`` (doc_id, dk, and more) with ``hashes``, the sorted n-gram hashes of the document."""
    more = [c for c in wanted.columns if c not in ("doc_id", "dk")]
    wanted = wanted.select(F.col("doc_id").alias("__id"), F.col("dk").alias("__dk"), *more)
    # Equal rows give equal sets; one of each is enough.
    rows = _keyed(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("dk") == F.col("__dk"))).select("text", *more)

    def batches(it):
        for batch in it:
            for a, b, hashes, first in gram_sets(batch.column(0), n):
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), lists], [*more, "hashes"])

    schema = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in more)
    return rows.mapInArrow(batches, f"{schema}, hashes array<long>")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the grams that at least two sets have, a strip of grams at a time."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, which, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n[which] > 1
    who, which = who[often], (np.cumsum(n > 1) - 1)[which[often]]
    order = np.argsort(which, kind="stable")
    who, which = who[order], which[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for lo in range(0, int((n > 1).sum()), width):
        x, y = np.searchsorted(which, (lo, lo + width))
        strip = np.zeros((len(sets), width), np.float32)
        strip[who[x:y], which[x:y] - lo] = 1
        out += strip @ strip.T
    return out


def linked(sets: list[np.ndarray], bands: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the classes share a band and have at least that Jaccard similarity."""
    share = np.zeros((len(sets), len(sets)), bool)
    for b in range(bands.shape[1]):
        share |= bands[:, b][:, None] == bands[:, b][None, :]
    np.fill_diagonal(share, False)
    if not share.any():
        return share
    size = np.array([len(s) for s in sets], np.float64)
    both = _common(sets).astype(np.float64)
    union = size[:, None] + size[None, :] - both
    return share & (both >= similarity * union - 1e-9)


_LINKS = "node long, root long, links long"


def _verify_piece(rows: pd.DataFrame, similarity: float) -> list[tuple]:
    """(class, a linked class or itself, links of this piece) for each class of one piece."""
    nodes, docs, own = rows["node"].to_numpy(), rows["docs"].to_numpy(), rows["own"].to_numpy()
    hit = linked([np.asarray(h).view(U) for h in rows["hashes"]], np.stack([np.asarray(b) for b in rows["bands"]]), similarity)
    if rows["piece_i"].iloc[0] != rows["piece_j"].iloc[0]:
        hit &= own[:, None] != own[None, :]  # pairs within a block belong to the block's own piece
    forest = Forest(len(rows))
    for x, y in zip(*np.nonzero(np.triu(hit))) if hit.sum() <= 4 * len(rows) else _spanning(hit):
        forest.join(int(x), int(y))
    return list(zip(nodes, nodes[forest.roots()], hit @ docs))


def _spanning(hit: np.ndarray):
    """Links that connect what ``hit`` connects, found from one node to its unseen neighbours."""
    unseen = np.ones(len(hit), bool)
    for s in range(len(hit)):
        if not unseen[s]:
            continue
        unseen[s] = False
        todo = [s]
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(hit[x] & unseen):
                unseen[y] = False
                todo.append(int(y))
                yield x, y


def _verify(similarity: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["grp", "piece_i", "piece_j", "node"])
        out = [x for _, piece in rows.groupby(["grp", "piece_i", "piece_j"]) if len(piece) > 1 for x in _verify_piece(piece, similarity)]
        return pd.DataFrame(out, columns=["node", "root", "links"])

    return run


def similar_documents(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, dk, class_id, copy_id, n_links) of every row of ``docs``.

    Rows whose sets of ``n`` consecutive words have at least ``similarity`` are linked. ``copy_id`` is the least
    id with an equal set, ``class_id`` the least id of the connected group of links, ``n_links`` how many other
    rows are linked to the row, equal ones included. Links between unequal sets are found with at least the
    chance ``recall`` each; equal sets always. Texts without words (null ones too) link to nothing. ``dk`` is the
    text's hash. Ids may be null (then the group's ids are the least that are not) or repeated.
    """
    bands, per = band_layout(similarity, recall)
    rows = cut_lineage(_signature_rows(docs, n, bands, per), "grams")
    some = rows.filter("grams > 0")
    # A class is known by 64 bits of its set's two digests.
    node = F.xxhash64("set_a", "set_b", "grams")
    classes = cut_lineage(
        some.groupBy(node.alias("node")).agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "dk")).alias("rep"), F.count(F.lit(1)).alias("docs"), F.first("bands").alias("bands"),
        ).select("node", F.col("rep.doc_id").alias("copy_id"), F.col("rep.dk").alias("rep_dk"), "docs", "bands"), "grams",
    )
    keys = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    near = components(star_edges(keys, ["band", "hash"], "node"))
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    near = cut_lineage(near.join(sizes, "root"), "grams")
    members = classes.join(near, "node").select(F.col("copy_id").alias("doc_id"), F.col("rep_dk").alias("dk"), "node", F.col("root").alias("grp"), "size", "docs", "bands")
    sets, total = cut_counted(_set_rows(docs, members, n), "grams")
    dealt = block_pairs(sets, "grp", "size", "node", block)
    # Small groups share tasks; every piece of a large group has its own key.
    shard = F.when(F.col("size") <= block, F.pmod(F.xxhash64("grp"), F.lit(total // TASK + 1))).otherwise(F.xxhash64("grp", "piece_i", "piece_j"))
    dealt = dealt.withColumn("shard", shard).select("shard", "grp", "piece_i", "piece_j", "own", "node", "docs", "bands", "hashes")
    links = cut_lineage(dealt.groupBy("shard", F.when(F.col("piece_j") > 0, F.col("grp")).alias("apart")).applyInPandas(_verify(similarity), _LINKS), "grams")
    joined = components(links.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = joined.join(classes.select("node", "copy_id"), "node").groupBy("root").agg(F.min("copy_id").alias("class_id"))
    found = classes.select("node", "copy_id", "docs").join(counts, "node", "left").join(joined, "node", "left").join(groups, "root", "left")
    found = found.select("node", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    out = rows.select("doc_id", "dk", F.when(F.col("grams") > 0, node).alias("node")).join(found, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id", "dk", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of similar documents: the one with the least id, then the least text hash.

    Rows without words and rows with null ids stay. Rows equal in id and text are one document and share their fate.
    """
    found = similar_documents(docs, **how)
    group = F.coalesce("class_id", "copy_id")
    first = found.filter("class_id is not null and n_links > 0").groupBy(group.alias("class_id")).agg(F.min(F.struct("doc_id", "dk")).alias("first"))
    gone = found.filter("n_links > 0 and doc_id is not null").join(first, "class_id").filter(F.struct("doc_id", "dk") != F.col("first"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("dk").alias("__dk")).distinct()
    kept = docs.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__dk")), "left_anti")
    return kept
