"""Removal of long word sequences that an earlier document already has, by suffix automata of reference shards.

The reference of a table against itself is the table, which no executor could hold as automata. So
passages are first brought together: each window of 50 words is represented by its least 8-gram (its
anchor), windows of one document in a row with one anchor form a segment, and only segments whose anchor
another document has as well go on. Equal segments are settled by their digests. Different segments with a
common anchor are dealt to shards; a shard's automaton grows in document order, and each segment is streamed
through it for its matching statistics before it is added. Anchors with more segments than a shard should
hold take an exact way of their own, by digests of whole windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_counted, cut_lineage
from .kernel import Grams, U, as_bytes, mix, range_hashes, ranges, slices, word_spans

WINDOW = 50
ANCHOR = 8
#: Segments a shard holds on average; an anchor with more than HOT of them is settled by window digests.
SHARD, HOT = 1000, 2000
_OTHER = U(0xA5A5A5A5A5A5A5A5)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(values) - width + 1], out[width - have : len(values) - have + 1])


def segments(texts: pa.Array, window: int, anchor: int):
    """Per slice of texts: text of each segment, anchor, digest, first word and number of windows."""
    for a, b in slices(texts):
        data, offsets = as_bytes(texts.slice(a, b - a))
        starts, ends, first = word_spans(data, offsets)
        n = len(starts)
        if n < window:
            continue
        hashes = range_hashes(data, starts, ends)
        low = _sliding_min(Grams(hashes).all(anchor), window - anchor + 1)  # by first word of the window
        doc = np.repeat(np.arange(b - a), np.diff(first))
        whole = doc[: n - window + 1] == doc[window - 1 :]
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]]) | (low[at[1:]] != low[at[:-1]])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(at)))
        s = at[begin]
        e = s + count + window - 1
        # Two digests from unlike word values; the second replaces the anchor's bits beside the anchor itself.
        digest = Grams(hashes).runs(s, e) ^ (Grams(mix(hashes ^ _OTHER)).runs(s, e) << U(1))
        yield a + doc[s], low[s], digest, s - first[doc[s]], count


_SEGMENT = "anchor long, digest long, doc_id {id}, dk long, start int, windows int"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("dk"))


def _segment_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def batches(it):
        for batch in it:
            for row, low, digest, start, count in segments(batch.column(1), window, anchor):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low.view(np.int64)), pa.array(digest.view(np.int64)), batch.column(0).take(take), batch.column(2).take(take),
                     pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["anchor", "digest", "doc_id", "dk", "start", "windows"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).filter("doc_id is not null").mapInArrow(batches, _SEGMENT.format(id=kind))


class Automaton:
    """Suffix automaton over integers, grown text by text."""

    def __init__(self):
        self.next, self.link, self.length, self.last = [{}], [-1], [0], 0

    def begin(self) -> None:
        """Start a new text: what follows is not taken as a continuation."""
        self.last = 0

    def _copy(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, c: int) -> None:
        p, q = self.last, self.next[self.last].get(c)
        if q is not None:
            self.last = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, c)
            return
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[p] + 1)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, c)
        self.last = new

    def matches(self, items: list[int]) -> list[int]:
        """Matching statistics: for each place, the length of the longest sequence that ends there and occurs."""
        out, state, have, next_, link, length = [], 0, 0, self.next, self.link, self.length
        for c in items:
            while state and c not in next_[state]:
                state = link[state]
                have = length[state]
            to = next_[state].get(c)
            state, have = (0, 0) if to is None else (to, have + 1)
            out.append(have)
        return out


def _spans(ends: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal (first word, number of words) covered by the windows that end at these places."""
    cut = np.flatnonzero(np.diff(ends) > 1) + 1
    return [(int(r[0]) - window + 1, int(r[-1] - r[0]) + window) for r in np.split(ends, cut) if len(r)]


def _match_shard(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Spans of each segment that occur in a segment of a smaller document of the shard."""
    rows = rows.sort_values(["doc_id", "anchor", "digest"], kind="stable")
    ids: dict[str, int] = {}
    automaton, out, waiting, doc = Automaton(), [], [], None
    for anchor, digest, doc_id, words in zip(rows["anchor"], rows["digest"], rows["doc_id"], rows["words"]):
        if doc_id != doc:  # a document's own segments are added after all of them have been matched
            for text in waiting:
                automaton.begin()
                for c in text:
                    automaton.add(c)
            waiting, doc = [], doc_id
        text = [ids.setdefault(w, len(ids)) for w in words.split(" ")]
        ends = np.flatnonzero(np.array(automaton.matches(text)) >= window)
        out += [(anchor, digest, s, n) for s, n in _spans(ends, window)]
        waiting.append(text)
    return pd.DataFrame(out, columns=["anchor", "digest", "at", "n"])


_SPAN = "anchor long, digest long, at int, n int"


def _segment_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, digest, doc_id, words) of ``wanted`` (anchor, digest, doc_id, dk, start, size)."""
    lists = wanted.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("anchor", "digest", "start", "size")).alias("parts"))
    rows = _keyed(docs).join(lists, ["doc_id", "dk"]).select("doc_id", "text", "parts")

    def batches(it):
        for batch in it:
            out = ([], [], [], [])
            for doc_id, text, parts in zip(batch.column(0), batch.column(1), batch.column(2)):
                data, offsets = as_bytes(pa.array([text.as_py()], pa.string()))
                starts, ends, _ = word_spans(data, offsets)
                raw = data.tobytes()
                for p in parts.as_py():
                    s = p["start"]
                    words = [raw[x:y].decode() for x, y in zip(starts[s : s + p["size"]], ends[s : s + p["size"]])]
                    for col, v in zip(out, (p["anchor"], p["digest"], doc_id.as_py(), " ".join(words))):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), batch.schema.field(0).type, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["anchor", "digest", "doc_id", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"anchor long, digest long, doc_id {kind}, words string")


def _windows_of(batch: pa.RecordBatch, window: int):
    """Per slice of rows (anchor, digest, doc_id, words, ...): rows, row of each window, its place in the row, both digests."""
    for a, b in slices(batch.column(3), 1 << 20):
        data, offsets = as_bytes(batch.column(3).slice(a, b - a))
        starts, ends, first = word_spans(data, offsets)
        hashes = range_hashes(data, starts, ends)
        count = np.maximum(np.diff(first) - window + 1, 0)
        s = ranges(first[:-1], count)
        row = np.repeat(np.arange(b - a), count)
        yield batch.slice(a, b - a), row, s - first[row], *(Grams(h).runs(s, s + window).view(np.int64) for h in (hashes, mix(hashes ^ _OTHER)))


def _window_rows(rows: DataFrame, window: int) -> DataFrame:
    """(anchor, digest, doc_id, at, w1, w2): the digests of every window of segment texts, with its place in the segment."""

    def batches(it):
        for batch in it:
            for part, row, at, w1, w2 in _windows_of(batch, window):
                take = pa.array(row)
                cols = [*(part.column(i).take(take) for i in range(3)), pa.array(at.astype(np.int32)), pa.array(w1), pa.array(w2)]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "digest", "doc_id", "at", "w1", "w2"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"anchor long, digest long, doc_id {kind}, at int, w1 long, w2 long")


def _joined_spans(hits: DataFrame, window: int) -> DataFrame:
    """Spans of segments from (anchor, digest, at) of their windows that count."""

    def batches(it):
        for batch in it:
            out = [(anchor, digest, *span) for anchor, digest, ats in zip(*(c.to_pylist() for c in batch.columns)) for span in _spans(np.array(ats) + window - 1, window)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], ["anchor", "digest", "at", "n"])

    return hits.groupBy("anchor", "digest").agg(F.array_sort(F.collect_set("at")).alias("ats")).mapInArrow(batches, _SPAN)


def _hot_spans(texts: DataFrame, window: int) -> DataFrame:
    """What shards do, for anchors with many unlike segments: by digests of whole windows, each met by equality.

    A window that most segments have is one key of the join; its rows are split by adaptive skew handling.
    """
    rows = cut_lineage(_window_rows(texts, window), "segments")
    key = ["anchor", "w1", "w2"]
    known = rows.groupBy(*key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi")
    hits = rows.join(cut_lineage(known, "segments"), key).filter("lo < doc_id")
    return _joined_spans(hits.select("anchor", "digest", "at"), window)


def covered_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(doc_id, dk, at, n): spans of words of each document that earlier documents have, ``dk`` being its text's hash.

    A window counts if its words also stand in a document with a smaller id. Spans may overlap.
    """
    rows = cut_lineage(_segment_rows(docs, window, anchor), "segments")
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("digest") != F.max("digest")).alias("several"))
    rows = cut_lineage(rows.join(shared.filter("lo < hi").select("anchor", "several"), "anchor"), "segments")
    first = rows.groupBy("anchor", "digest").agg(
        F.min(F.struct("doc_id", "dk", "start")).alias("first"), F.max("doc_id").alias("hi"),
        F.first("windows").alias("windows"), F.first("several").alias("several"),
    )
    first = cut_lineage(first, "segments")
    # Segments that share an anchor but differ: one of each is matched.
    unlike = first.filter("several").select("anchor", "digest", "first.*", (F.col("windows") + window - 1).alias("size"))
    per_anchor = unlike.groupBy("anchor").agg(F.count(F.lit(1)).alias("many"))
    texts, n = cut_counted(_segment_texts(docs, unlike).join(per_anchor, "anchor"), "segments")

    few = texts.filter(F.col("many") <= hot).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(max(1, n // shard + 1))))
    match = lambda rows: _match_shard(rows, window)
    spans = few.select("shard", "anchor", "digest", "doc_id", "words").groupBy("shard").applyInPandas(match, _SPAN)
    late = _hot_spans(texts.filter(F.col("many") > hot).select("anchor", "digest", "doc_id", "words"), window)
    spans = cut_lineage(spans.unionByName(late), "segments")

    again = rows.join(first.filter("first.doc_id < hi").select("anchor", "digest", F.col("first.doc_id").alias("lo")), ["anchor", "digest"])
    again = again.filter("doc_id > lo").select("doc_id", "dk", F.col("start").alias("at"), (F.col("windows") + window - 1).alias("n"))
    # What holds for the first place of a segment holds for its other places in the same document.
    found = spans.join(first.select("anchor", "digest", F.col("first.doc_id").alias("lo")), ["anchor", "digest"])
    matched = rows.join(found, ["anchor", "digest"]).filter("doc_id = lo").select("doc_id", "dk", (F.col("start") + F.col("at")).alias("at"), "n")
    return again.unionByName(matched)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's words, joined by one space, without those of covered windows.

    Words are runs of characters other than space and U+0009 to U+000D. A null text has no words. Rows with a
    null id are returned whole and remove nothing; rows with equal ids do not remove from each other, and
    equal rows share their fate. An empty table gives an empty one; other columns do not matter.
    """
    spans = covered_spans(docs, window, **how).groupBy("doc_id", "dk").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("dk").alias("__dk"), "spans")
    rows = _keyed(docs).join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("dk") == F.col("__dk")), "left").select("doc_id", "text", "spans")

    def batches(it):
        for batch in it:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                data, offsets = as_bytes(part.column(1))
                starts, ends, first = word_spans(data, offsets)
                change = np.zeros(len(starts) + 1, np.int64)
                flat = part.column(2).flatten()
                if len(flat):
                    per = np.diff(np.frombuffer(part.column(2).buffers()[1], np.int32, b - a + 1, 4 * part.column(2).offset))
                    per = np.where(np.asarray(part.column(2).is_valid()), per, 0)
                    at = flat.field("at").to_numpy().astype(np.int64) + np.repeat(first[:-1], per)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + flat.field("n").to_numpy(), -1)
                keep = np.cumsum(change)[:-1] == 0
                kept = np.concatenate(([0], np.cumsum(keep)))
                # Kept words with one space after each; the last one of a text goes.
                s, e = starts[keep], ends[keep]
                size = e - s + 1
                bounds = np.concatenate(([0], np.cumsum(size)))
                out = np.full(bounds[-1], 0x20, np.uint8)
                out[ranges(bounds[:-1], size - 1)] = data[ranges(s, size - 1)]
                raw, doc = out.tobytes(), kept[first]
                texts = [raw[bounds[x] : max(bounds[x], bounds[y] - 1)].decode() for x, y in zip(doc[:-1], doc[1:])]
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(n - np.diff(doc)), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
