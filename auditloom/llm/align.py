"""Alignment of two tokenizers over the same bytes.

Both encode space + text. Byte offsets at which a token of either side ends cut the tokens into groups; an A and a B
token whose byte ranges overlap are linked. Ends alone say all of it: between two neighbouring ends of either side
lies exactly one link, and an end of both closes a group.

Long texts go through an associative monoid. A byte range of a text is a fragment: an open prefix (tokens up to its
first common end), closed groups, and an open suffix. Composing two fragments closes the group that the left one's
suffix and the right one's prefix make; it is associative, so fragments made in different tasks are composed in a
tree, a fixed number at a time, until a text is one fragment. Texts are encoded in pieces cut only where neither
tokenizer's tokens can reach across: before a single space between two other characters.

How often an id pair is linked is counted over the corpus. Tasks put texts together in blocks of bounded size and
count a block's pairs before any shuffle; the counts come back to a block's own pairs, not to every text's.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: A text of more characters is encoded in pieces of at least this many.
PIECE = 1 << 15
#: Bytes of a fragment, fragments composed by one task at a time, bytes of text in a block, and encoded at once.
RANGE, FAN, BLOCK, AT_ONCE = 1 << 13, 16, 4 << 20, 1 << 19
#: Ids fit 16 bits on either side: a pair is a * 2 ** 16 + b.
SIDE = 16
# The public byte-level pre-tokenizer's pattern; its file names it only by kind ("ByteLevel", use_regex).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones are themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """Ids of texts and the bytes of each id."""

    def __init__(self, raw: list[bytes], encode):
        self.raw, self.encode = raw, encode
        self.size = np.array([len(r) for r in raw], np.int64)


@functools.lru_cache(2)
def byte_level(path: str) -> Side:
    """A byte-level merge vocabulary. Ids rank the merges, so the ranks alone encode; special strings are plain text."""
    import tiktoken

    letters, vocab = _byte_letters(), json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
    raw = [b""] * (max(vocab.values()) + 1)
    for token, i in ranks.items():
        raw[i] = token
    own = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return Side(raw, lambda texts: [own.encode_ordinary(t) for t in texts])


@functools.lru_cache(2)
def piece_level(path: str) -> Side:
    """A piece vocabulary; its library puts the first space itself, so texts are given without it."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
    raw = [bytes([int(t[3:5], 16)]) if lib.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)]
    return Side(raw, lambda texts: lib.encode([t[1:] for t in texts], num_threads=1))


def _ids(side: Side, texts: list[str], raw: list[bytes]) -> list:
    """The ids of each text, None where their bytes are not the text's own."""
    out = side.encode(texts)
    return [ids if b"".join(map(side.raw.__getitem__, ids)) == r else None for ids, r in zip(out, raw)]


def encode_both(texts: list[str], a: Side, b: Side) -> list[tuple[list[int], list[int]] | None]:
    raw = [t.encode() for t in texts]
    return [None if x is None or y is None else (x, y) for x, y in zip(_ids(a, texts, raw), _ids(b, texts, raw))]


# ---- groups and links of a stretch that both sides end with ----

_DIGITS = np.array([list(str(i).ljust(6)) for i in range(1 << SIDE)]).view(np.uint32).astype(np.uint8).reshape(-1, 6)
_WIDTH = np.array([len(str(i)) for i in range(1 << SIDE)])


def join_tokens(ends_a: np.ndarray, a: np.ndarray, ends_b: np.ndarray, b: np.ndarray) -> SimpleNamespace:
    """Links (their end, pair), group ends, and for each group end the place in the written groups, which are bytes.

    Ends ascend, and both sides end alike.
    """
    size = int(ends_a[-1]) + 1 if len(a) else 1
    mark = np.zeros(size, np.uint8)
    mark[ends_a] = 1
    mark[ends_b] |= 2
    at = np.flatnonzero(mark)
    has = mark[at].astype(np.int64)
    ia, ib = np.cumsum(has & 1) - (has & 1), np.cumsum(has >> 1) - (has >> 1)
    pair = (a[ia].astype(np.int64) << SIDE) | b[ib]
    both = has == 3
    closes = at[both]
    # A group's A ids stand before its B ids; a token's place is its own number and that of the other side's before it.
    n_a, n_b = ia[both] + 1, ib[both] + 1
    group_a, group_b = np.searchsorted(closes, ends_a), np.searchsorted(closes, ends_b)
    place_a = np.arange(len(a)) + np.concatenate([[0], n_b])[group_a]
    place_b = np.arange(len(b)) + n_a[group_b] if len(b) else np.zeros(0, np.int64)
    number = np.empty(len(a) + len(b), np.int64)
    number[place_a], number[place_b] = a, b
    mark_after = np.full(len(number), ord(","), np.uint8)
    mark_after[place_a[n_a - 1]] = ord("|")
    mark_after[place_b[n_b - 1]] = ord(";")
    digits, width = _DIGITS[number], _WIDTH[number]
    digits[np.arange(len(number)), width] = mark_after
    written = digits[np.arange(6) <= width[:, None]].tobytes()
    upto = np.cumsum(width + 1)
    return SimpleNamespace(at=at, pair=pair, closes=closes, n_a=n_a, n_b=n_b, written=written, upto=upto[n_a + n_b - 1] if len(number) else np.zeros(0, np.int64))


def _flat(lists: list, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))
    return ids, np.cumsum(size[ids])


def align_texts(texts: list[str | None], a: Side, b: Side) -> list[SimpleNamespace | None]:
    """Each text's numbers, written groups, distinct pairs and how often each is linked; None for texts without tokens."""
    out: list = [None] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    coded = encode_both([" " + texts[i] for i in some], a, b)
    some, coded = [i for i, c in zip(some, coded) if c], [c for c in coded if c]
    if not some:
        return out
    ids_a, ends_a = _flat([c[0] for c in coded], a.size)
    ids_b, ends_b = _flat([c[1] for c in coded], b.size)
    g = join_tokens(ends_a, ids_a, ends_b, ids_b)
    stop = ends_a[np.cumsum([len(c[0]) for c in coded]) - 1]  # both sides end with the text
    link_to, group_to = np.searchsorted(g.at, stop, "right"), np.searchsorted(g.closes, stop, "right")
    keys, times = np.unique((np.repeat(np.arange(len(some)), np.diff(link_to, prepend=0)) << 2 * SIDE) | g.pair, return_counts=True)
    own = np.searchsorted(keys >> 2 * SIDE, np.arange(len(some) + 1))
    start = 0
    for k, i in enumerate(some):
        end = int(g.upto[group_to[k] - 1])
        x = slice(own[k], own[k + 1])
        out[i] = SimpleNamespace(
            n_a=len(coded[k][0]), n_b=len(coded[k][1]), n_groups=int(group_to[k] - (group_to[k - 1] if k else 0)),
            groups=g.written[start : end - 1], pairs=keys[x] & ((1 << 2 * SIDE) - 1), times=times[x],
        )
        start = end
    return out


# ---- the monoid of fragments ----

_OPEN = "struct<a:array<int>,ends_a:array<long>,b:array<int>,ends_b:array<long>>"
FRAGMENT = f"cut boolean, prefix {_OPEN}, groups binary, n_groups long, pairs array<long>, times array<long>, suffix {_OPEN}, n_a long, n_b long, whole boolean"


def _tokens(a, ends_a, b, ends_b) -> dict:
    return {"a": list(a), "ends_a": list(ends_a), "b": list(b), "ends_b": list(ends_b)}


def _plus(x: dict, y: dict) -> dict:
    return {k: [*x[k], *y[k]] for k in x}


def _closed(t: dict) -> tuple[bytes, int, dict]:
    """A stretch of tokens as groups (ended by `;`), their number, and its links by pair."""
    if not t["a"]:
        return b"", 0, {}
    base = min(t["ends_a"][0], t["ends_b"][0]) - 1
    g = join_tokens(np.array(t["ends_a"]) - base, np.array(t["a"]), np.array(t["ends_b"]) - base, np.array(t["b"]))
    return g.written, len(g.closes), dict(zip(*map(np.ndarray.tolist, np.unique(g.pair, return_counts=True))))


def _merged(*counts: dict) -> dict:
    out = dict(counts[0])
    for more in counts[1:]:
        for k, v in more.items():
            out[k] = out.get(k, 0) + v
    return out


def fragment(a, ends_a, b, ends_b) -> dict:
    """The fragment of the tokens that end in a byte range."""
    a, ends_a, b, ends_b = (np.asarray(x, np.int64) for x in (a, ends_a, b, ends_b))
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(common):
        return _part(False, _tokens(a, ends_a, b, ends_b), b"", 0, {}, _tokens((), (), (), ()), len(a), len(b))
    cuts = [np.searchsorted(e, [common[0], common[-1]], "right") for e in (ends_a, ends_b)]
    (a0, a1), (b0, b1) = cuts
    groups, n, links = _closed(_tokens(a[a0:a1], ends_a[a0:a1], b[b0:b1], ends_b[b0:b1]))
    return _part(True, _tokens(a[:a0], ends_a[:a0], b[:b0], ends_b[:b0]), groups, n, links, _tokens(a[a1:], ends_a[a1:], b[b1:], ends_b[b1:]), len(a), len(b))


def _part(cut, prefix, groups, n_groups, links, suffix, n_a, n_b, whole=True) -> dict:
    return {"cut": cut, "prefix": prefix, "groups": groups, "n_groups": n_groups, "links": links, "suffix": suffix, "n_a": n_a, "n_b": n_b, "whole": whole}


def compose(f: dict, g: dict) -> dict:
    """Two neighbouring byte ranges as one; associative, with a range without tokens as its neutral element."""
    n_a, n_b, whole = f["n_a"] + g["n_a"], f["n_b"] + g["n_b"], f["whole"] and g["whole"]
    if not f["cut"]:
        return _part(g["cut"], _plus(f["prefix"], g["prefix"]), g["groups"], g["n_groups"], g["links"], g["suffix"], n_a, n_b, whole)
    if not g["cut"]:
        return _part(True, f["prefix"], f["groups"], f["n_groups"], f["links"], _plus(f["suffix"], g["prefix"]), n_a, n_b, whole)
    groups, n, links = _closed(_plus(f["suffix"], g["prefix"]))
    return _part(
        True, f["prefix"], f["groups"] + groups + g["groups"], f["n_groups"] + n + g["n_groups"],
        _merged(f["links"], links, g["links"]), g["suffix"], n_a, n_b, whole,
    )


def finished(f: dict) -> SimpleNamespace | None:
    """The alignment of a text from its one fragment: its open prefix is its first group."""
    if not f["whole"] or not f["cut"]:
        return None
    groups, n, links = _closed(f["prefix"])
    links = sorted(_merged(links, f["links"]).items())
    return SimpleNamespace(
        n_a=f["n_a"], n_b=f["n_b"], n_groups=n + f["n_groups"], groups=(groups + f["groups"])[:-1],
        pairs=np.array([k for k, _ in links], np.int64), times=np.array([v for _, v in links], np.int64),
    )


def _to_row(f: dict) -> dict:
    out = {k: v for k, v in f.items() if k != "links"}
    return out | {"pairs": list(f["links"].keys()), "times": list(f["links"].values())}


def _of_row(r: dict) -> dict:
    return {k: v for k, v in r.items() if k not in ("pairs", "times", "row", "at")} | {"links": dict(zip(r["pairs"], r["times"]))}


# ---- Spark ----

_CUT = re.compile(r"(?<=\S) (?=\S)")


def _pieces(text: str, piece: int) -> Iterator[tuple[int, str]]:
    """(byte offset, piece) of space + text; every piece begins with a space that stands alone."""
    text, start, at_byte = " " + text, 0, 0
    while start < len(text):
        place = _CUT.search(text, start + piece)
        end = place.start() if place else len(text)
        yield at_byte, text[start:end]
        at_byte += len(text[start:end].encode())
        start = end


def _text(value: bytes | None) -> str | None:
    try:
        return None if value is None else value.decode()
    except UnicodeDecodeError:
        return None


def _arrow_type(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


_ROW = "block long, is_block boolean, id binary, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>"


class _Blocks:
    """Rows of aligned texts, put together in blocks: a text's pairs are places in its block's own list."""

    def __init__(self, schema: pa.Schema, side: int, written: bool):
        self.schema, self.side, self.written, self.n = schema, side, written, 0

    def batch(self, ids: list, found: list) -> pa.RecordBatch:
        block = (TaskContext.get().partitionId() << 34) | (self.n << 1) | self.side
        self.n += 1
        pairs = np.concatenate([f.pairs for f in found if f] or [np.zeros(0, np.int64)])
        times = np.concatenate([f.times for f in found if f] or [np.zeros(0, np.int64)])
        own, place = np.unique(pairs, return_inverse=True)
        total = np.bincount(place, times, len(own)).astype(np.int64)
        rows, at = [], 0
        for i, f in zip(ids, found):
            if f is None:
                rows.append((block, False, i, 0, 0, 0, "", [], []))
                continue
            groups = f.groups.decode() if self.written else hashlib.sha256(f.groups).hexdigest()
            rows.append((block, False, i, f.n_a, f.n_b, f.n_groups, groups, place[at : at + len(f.pairs)], f.times))
            at += len(f.pairs)
        rows.append((block, True, None, None, None, None, None, own, total))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.schema.types)], schema=self.schema)


def _short(paths: tuple[str, str], written: bool, block: int):
    schema = _arrow_type(_ROW)

    def run(batches):
        a, b, out = byte_level(paths[0]), piece_level(paths[1]), _Blocks(schema, 0, written)
        for batch in batches:
            first = start = size = taken = 0
            found: list = []
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                size, taken = size + n, taken + n
                last = i == batch.num_rows - 1
                if taken >= AT_ONCE or last:
                    found += align_texts([_text(x) for x in batch.column(1).slice(start, i + 1 - start).to_pylist()], a, b)
                    start, taken = i + 1, 0
                    if size >= block or last:
                        yield out.batch(batch.column(0).slice(first, i + 1 - first).to_pylist(), found)
                        first, size, found = i + 1, 0, []
    return run


def _cut_pieces(piece: int):
    schema = _arrow_type("row long, at long, piece string")

    def run(batches):
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = _text(raw)
                for at, part in _pieces(text, piece) if text is not None else [(0, None)]:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((row, at, part), schema.types)], schema=schema)
    return run


def _fragments(paths: tuple[str, str], size: int):
    """Encode pieces, deal their tokens to byte ranges of the text by where they end."""
    schema = _arrow_type(f"row long, at long, {FRAGMENT}")

    def run(batches):
        a, b = byte_level(paths[0]), piece_level(paths[1])
        for batch in batches:
            rows = []
            for row, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                coded = None if text is None else encode_both([text], a, b)[0]
                if coded is None:
                    empty = _tokens((), (), (), ())
                    rows.append(_to_row(_part(False, empty, b"", 0, {}, empty, 0, 0, False)) | {"row": row, "at": at})
                    continue
                (ia, ea), (ib, eb) = (_flat([c], s.size) for c, s in zip(coded, (a, b)))
                ea, eb = ea + at, eb + at
                for k in range(at // size, int(ea[-1] - 1) // size + 1):
                    (a0, a1), (b0, b1) = (np.searchsorted(e, [k * size, (k + 1) * size], "right") for e in (ea, eb))
                    if a0 < a1 or b0 < b1:
                        rows.append(_to_row(fragment(ia[a0:a1], ea[a0:a1], ib[b0:b1], eb[b0:b1])) | {"row": row, "at": max(at, k * size)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def _compose_rows(table: pa.Table) -> pa.Table:
    rows = table.sort_by("at").to_pylist()
    whole = functools.reduce(compose, map(_of_row, rows))
    return pa.Table.from_pylist([_to_row(whole) | {"row": rows[0]["row"], "at": rows[0]["at"]}], schema=table.schema)


def _finish(written: bool):
    schema = _arrow_type(_ROW)

    def run(batches):
        out = _Blocks(schema, 1, written)
        for batch in batches:
            for r in batch.to_pylist():
                yield out.batch([r["id"]], [finished(_of_row({k: v for k, v in r.items() if k != "id"}))])
    return run


def _long(texts: DataFrame, paths, written: bool, piece: int, size: int, fan: int) -> DataFrame:
    """Alignment rows of long texts (id, text): pieces encoded apart, fragments composed in a tree."""
    texts = cut_lineage(texts.withColumn("row", F.monotonically_increasing_id()), "align")
    pieces = texts.select("row", "text").mapInArrow(_cut_pieces(piece), "row long, at long, piece string")
    fragments = pieces.repartition("row", "at").mapInArrow(_fragments(paths, size), f"row long, at long, {FRAGMENT}")
    fragments = cut_lineage(fragments, "align")
    # A piece begins inside a byte range, so a range may have two fragments: twice as many as ranges, at most.
    bound = 2 * ((texts.agg(F.max(F.octet_length("text"))).first()[0] or 0) // size + 2)
    width = size
    while bound > 1:
        width, bound = width * fan, -(-bound // fan)
        last = bound <= 2
        key = F.lit(0) if last else F.floor(F.col("at") / width)
        fragments = fragments.groupBy("row", key.alias("k")).applyInArrow(_compose_rows, fragments.schema)
        if last:
            break
    # Written first: a task would else hold two Python workers, one for either step.
    return cut_lineage(fragments, "align").join(texts.select("row", "id"), "row").drop("row").mapInArrow(_finish(written), _ROW)


def aligned_blocks(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", paths: tuple[str, str] = (BYTE_BPE, PIECES), written: bool = True,
    piece: int = PIECE, size: int = RANGE, fan: int = FAN, block: int = BLOCK,
) -> DataFrame:
    """Rows of texts and of blocks, written once; see :func:`align`."""
    rows = docs.select(F.col(doc_id).cast("string").cast("binary").alias("id"), F.col(text).cast("binary").alias("text"))
    long = F.coalesce(F.octet_length("text") > 2 * piece, F.lit(False))
    short = rows.filter(~long).mapInArrow(_short(paths, written, block), _ROW)
    return cut_lineage(short.unionByName(_long(rows.filter(long), paths, written, piece, size, fan)), "align")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): links of every id pair over the corpus, and whether it is its B id's highest."""
    pairs = blocks.filter("is_block").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = pairs.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND((1 << SIDE) - 1))
    # At most one row per id of B.
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _score(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's texts with what the corpus says of their links."""
    n = right.num_rows
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    place = right.column("place").to_numpy()
    count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    sums = []
    for part in left.to_batches():
        for p, t in zip(part.column("pairs"), part.column("times")):
            p, t = p.values.to_numpy(), t.values.to_numpy()
            sums.append((int(t.sum()), int(t @ best[p]), int(t @ count[p])))
    out = left.select(["id", "n_a", "n_b", "n_groups"])
    for i, name in enumerate(("n_links", "n_best", "count_sum")):
        out = out.append_column(name, pa.array([s[i] for s in sums], pa.int64()))
    return out.append_column("groups", left.column("groups"))


def align(docs: DataFrame, doc_id: str = "doc_id", written: bool = True, **how) -> DataFrame:
    """One row per row of ``docs``: its id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    ``groups`` is `a1,a2|b1;a3|b2,b3`: A and B ids of each group, or with ``written=False`` only its sha-256 (so that no
    table has to hold the text). Texts that are null, empty, no valid UTF-8, or that either side does not give back byte
    by byte have no tokens: zeros, and an empty string in ``groups``. Ids may be null or repeated; equal texts get equal rows and
    count as often as they occur. Other columns are ignored. An empty table gives an empty one.
    """
    blocks = aligned_blocks(docs, doc_id, written=written, **how)
    own = blocks.filter("is_block").select("block", F.posexplode("pairs").alias("place", "pair")).join(pair_counts(blocks), "pair")
    texts = blocks.filter("not is_block").select("block", "id", "n_a", "n_b", "n_groups", "groups", "pairs", "times")
    own = own.select(F.col("block").alias("of"), "place", "count", "best")
    scored = texts.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(
        _score, "id binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string",
    )
    kind = docs.schema[doc_id].dataType
    return scored.select(F.col("id").cast("string").cast(kind).alias(doc_id), *[c for c in scored.columns if c != "id"])
