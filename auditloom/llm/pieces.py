"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's segmentations are the paths of a lattice whose edges are pieces. Weights are max-plus: an edge is
open (a finite weight) after the piece before it or closed (minus infinity). For a merge (BPE) model an edge is open if merging
the two neighbours' characters alone gives just these two pieces; exactly one path of open edges remains, the
merge order's own result, and it is found position by position. A giant text is cut into chunks
anywhere. Each chunk yields a transfer matrix between the states at its two borders (how far back the last piece
ends, and which it is), matrices combine associatively, and then every chunk is backtraced on its own.

The vocabulary file is read by its public library; texts are never given to it.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .base import text_key
from .kernel import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk. Texts up to this length are one chunk.
CHUNK = 1 << 15
SPACE = "▁"
NONE = -1
#: Units that a worker remembers, and the longest one that is encoded among others.
_MEMO, _SHORT = 150_000, 24
#: Units walked at once, and bytes of text encoded at once: what a worker holds besides the memo.
_BATCH, _SLICE = 4096, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary: the pieces, which pairs of them may be neighbours, and both directions for one chunk."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.lib.vocab_size()
        text = [self.lib.id_to_piece(i) for i in range(n)]
        special = [self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i) for i in range(n)]
        self.text, self.ids = text, {t: i for i, t in enumerate(text) if not special[i]}
        self.score = {t: self.lib.get_score(i) for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        byte = {int(text[i][3:5], 16): i for i in range(n) if self.lib.is_byte(i)}
        self.byte = [byte.get(b, self.lib.unk_id()) for b in range(256)]
        self.raw = [b"" if self.lib.is_control(i) or self.lib.is_unknown(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(text)]
        for b, i in byte.items():
            self.raw[i] = bytes([b])
        # No piece leads from another character to a space mark: what such marks part is independent.
        self.units = not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        # Nor does any piece hold a line feed, if it has none itself: it parts units too.
        self.feed = feed = "" if any("\n" in t for t in self.ids) else "\n"
        self.unit_re = re.compile(f"{SPACE}*[^{SPACE}{feed}]+|{SPACE}+|\n+") if self.units else re.compile("(?s).+")
        self.merges: dict[int, tuple] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self._table()

    def _table(self) -> None:
        """Open-addressed table of pieces by the hash of their characters, and a direct-mapped cache of pairs."""
        self.size = 1 << (4 * len(self.ids)).bit_length()
        self.keys, self.values = np.zeros(self.size, np.uint64), np.full(self.size, NONE, np.int32)
        hashes = np.zeros(len(self.ids), np.uint64)
        for k, t in enumerate(self.ids):
            h = 0
            for c in t:
                h = (h * int(_MIX) + ord(c) + 1) % (1 << 64)
            hashes[k] = h
        self.shift, self.probes = np.uint64(64 - (self.size.bit_length() - 1)), 1
        for h, slot, i in zip(hashes.tolist(), ((hashes * _MIX) >> self.shift).tolist(), self.ids.values()):
            n = 1
            while self.values[slot] != NONE:
                slot, n = (slot + 1) % self.size, n + 1
            self.keys[slot], self.values[slot], self.probes = h, i, max(self.probes, n)
        self.unknown = self.lib.vocab_size()
        self.pair_keys, self.pair_open = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, or NONE."""
        slot = ((hashes * _MIX) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, self.values[slot], NONE)
        left = np.flatnonzero((out == NONE) & (self.values[slot] != NONE))
        for _ in range(1, self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) % self.size
            hit = self.keys[slot[left]] == hashes[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (self.values[slot[left]] != NONE)]
        return out

    def _open(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``open`` for many pairs; ``unknown`` stands for any character without a piece."""
        keys = (before.astype(np.int64) + 1) << 20 | piece
        slot = ((keys.astype(np.uint64) * _MIX) >> np.uint64(44)).astype(np.int64)
        for key in np.unique(keys[self.pair_keys[slot] != keys]).tolist():
            b, p = (key >> 20) - 1, key & 0xFFFFF
            at = int((key * int(_MIX)) % (1 << 64)) >> 44
            self.pair_keys[at], self.pair_open[at] = key, self.open(-2 if b == self.unknown else b, -2 if p == self.unknown else p)
        # Two keys of one call may share a slot: the one that lost it is asked for by itself.
        out, lost = self.pair_open[slot], np.flatnonzero(self.pair_keys[slot] != keys)
        for x in lost.tolist():
            b, p = int(before[x]), int(piece[x])
            out[x] = self.open(-2 if b == self.unknown else b, -2 if p == self.unknown else p)
        return out

    def encode_units(self, units: list[str]) -> None:
        """Fill the memo with units of at most ``_SHORT`` characters, all of them walked at once, place by place."""
        for lo, hi in ((0, 8), (8, 14), (14, _SHORT)):
            some = [u for u in units if lo < len(u) <= hi]
            for at in range(0, len(some), _BATCH):
                self._encode_padded(some[at : at + _BATCH], hi)

    def _encode_padded(self, units: list[str], width: int) -> None:
        codes = np.frombuffer("".join(u.ljust(width, "\x00") for u in units).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = codes.reshape(len(units), width).astype(np.uint64) + np.uint64(1)
        size = np.array([len(u) for u in units])
        hashes, found = np.zeros((len(units), width + 1), np.uint64), []
        for n in range(1, min(width, self.longest) + 1):
            hashes = hashes[:, :-1] * _MIX + codes[:, n - 1 :]
            found.append(self._find(hashes.reshape(-1)).reshape(hashes.shape))
        found[0] = np.where(found[0] == NONE, self.unknown, found[0])
        any_piece = [(f != NONE).any(axis=0).tolist() for f in found]
        last = np.full((len(units), width + 1), -2, np.int32)  # -2: not reached
        last[:, 0] = NONE
        start = np.zeros((len(units), width + 1), np.int8)
        for e in range(1, width + 1):
            todo = np.flatnonzero(size >= e)
            for n in range(min(e, len(found)), 0, -1):
                if not any_piece[n - 1][e - n]:
                    continue
                piece, before = found[n - 1][todo, e - n], last[todo, e - n]
                may = np.flatnonzero((piece != NONE) & (before != -2))
                if not len(may):
                    continue
                may = may[self._open(before[may], piece[may])]
                last[todo[may], e], start[todo[may], e] = piece[may], e - n
                keep = np.ones(len(todo), bool)
                keep[may] = False
                todo = todo[keep]
        for unit, n, pieces, starts in zip(units, size.tolist(), last.tolist(), start.tolist()):
            out = []
            while n:
                s = starts[n]
                out.append(pieces[n])
                if pieces[n] == self.unknown:
                    out[-1:] = [self.byte[b] for b in reversed(unit[s:n].encode())]
                n = s
            self.memo[unit] = tuple(out[::-1])

    def steps(self, piece: int) -> tuple[bool, list[float], list[str], list[str]]:
        """How a piece's characters merge by themselves: whether to the piece, each merge's score, and the outer parts between merges."""
        found = self.merges.get(piece)
        if found is None:
            parts, scores, score = list(self.text[piece]), [], self.score
            left, right = [parts[0]], [parts[-1]]
            while True:
                joint = [score.get(a + b) for a, b in zip(parts, parts[1:])]
                best = max((s for s in joint if s is not None), default=None)
                if best is None:
                    break
                i = joint.index(best)  # the leftmost of equal ones
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                scores.append(best)
                left.append(parts[0])
                right.append(parts[-1])
            found = self.merges[piece] = (len(parts) == 1, scores, left, right)
        return found

    def open(self, before: int, piece: int) -> bool:
        """May ``piece`` follow ``before``: do their characters, merged together, give just these two.

        The merges of either side come in their own order; the next of all is the one that scores highest, the
        leftmost of equals. The pair is closed if that is ever the one across the border. Unknown characters merge with nothing.
        """
        found = self.pairs.get((before, piece))
        if found is None:
            found = all(p < 0 or self.steps(p)[0] for p in (before, piece))
            if found and before >= 0 and piece >= 0:
                _, a, _, ends = self.steps(before)
                _, b, begins, _ = self.steps(piece)
                i = j = 0
                while True:
                    across = self.score.get(ends[i] + begins[j])
                    own, other = a[i] if i < len(a) else None, b[j] if j < len(b) else None
                    if across is not None and (own is None or across > own) and (other is None or across >= other):
                        found = False
                        break
                    if own is None and other is None:
                        break
                    if other is None or own is not None and own >= other:
                        i += 1
                    else:
                        j += 1
            self.pairs[before, piece] = found
        return found

    def paths(self, chars: str, before: int, first_end: int = 1) -> dict[int, tuple[int, int]]:
        """For each reachable place, (last piece, where it starts), from place 0 with ``before`` as the piece before it.

        The first piece ends at ``first_end`` or later. Each place has one open last piece at most.
        """
        last = {0: (before, 0)}
        ids, longest, pairs = self.ids.get, self.longest, self.pairs
        for e in range(1, len(chars) + 1):
            for s in range(e - longest if e > longest else 0, e):
                piece = ids(chars[s:e])
                if piece is None and e - s > 1 or s not in last or (s == 0 and e < first_end):
                    continue
                if piece is None:
                    piece = -2 - ord(chars[s])
                before_s = last[s][0]
                ok = pairs.get((before_s, piece))
                if ok or ok is None and self.open(before_s, piece):
                    last[e] = (piece, s)
                    break
        return last

    def walk(self, chars: str, before: int = NONE, first_end: int = 1) -> list[int]:
        """The ids of the path that ends at the end of ``chars``."""
        last, out, at = self.paths(chars, before, first_end), [], len(chars)
        while at:
            piece, start = last[at]
            out.append([piece] if piece >= 0 else [self.byte[b] for b in chars[start:at].encode()])
            at = start
        return [i for part in reversed(out) for i in part]

    def encode(self, chars: str, before: int = NONE, first_end: int = 1) -> list[int]:
        """The ids of marked text, whose first piece follows ``before``."""
        return self.encode_many([(chars, before, first_end)])[0].tolist()

    def encode_many(self, texts: list[tuple[str, int, int]]) -> list[np.ndarray]:
        """The ids of each (marked text, piece before it, least end of its first piece)."""
        units = [self.unit_re.findall(t) for t, _, _ in texts]
        heads: list[list[int]] = []
        for own, (_, before, first_end) in zip(units, texts):
            # A text that begins within a unit has its own start; all other units begin afresh.
            heads.append(self.walk(own.pop(0), before, first_end) if own and (before != NONE or first_end > 1) else [])
        here = set(chain.from_iterable(units))
        if len(self.memo) > _MEMO:
            # Units that come again are likely frequent ones.
            self.memo = {u: self.memo[u] for u in here if u in self.memo}
        memo = self.memo
        new = [u for u in here if u not in memo]
        if len(new) >= 2000:
            self.encode_units(new)
        else:
            memo.update({u: tuple(self.walk(u)) for u in new if len(u) <= _SHORT})
        long = {u: self.walk(u) for u in new if len(u) > _SHORT}
        memo.update(long)
        out = [np.fromiter(chain(head, chain.from_iterable(map(memo.get, own))), np.int32) for head, own in zip(heads, units)]
        for u in long:
            del memo[u]
        return out

    def decode(self, ids) -> str:
        """The text of ids; the mark that encoding puts first is taken off."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    # ---- chunks ----

    def starts_unit(self, text: str, at: int) -> bool:
        """Is what follows a place independent of what is before it."""
        if not self.units or at == 0:
            return at == 0
        return text[at : at + 1] == SPACE != text[at - 1] or text[at - 1] == self.feed

    def entries(self, text: str, at: int) -> list[tuple[int, int]]:
        """Possible states at a border: (characters since the last piece's end, that piece)."""
        out = []
        for back in range(min(self.longest - 1, at) + 1):
            end = at - back
            if end == 0 or self.starts_unit(text, end):
                out.append((back, NONE))
                continue
            found = [self.ids[text[s:end]] for s in range(max(0, end - self.longest), end) if text[s:end] in self.ids]
            out += [(back, p) for p in found]
            if text[end - 1] not in self.ids:
                out.append((back, -2 - ord(text[end - 1])))
        return out

    def transfer(self, text: str, lo: int, hi: int) -> dict[tuple, float]:
        """Weights (0 for open) from each entry state at ``lo`` to each exit state at ``hi`` of ``text``.

        ``text`` reaches back far enough for pieces across ``lo``. Where a unit begins inside the chunk, all entries
        meet in one state, so only the stretch before it is walked once per entry.
        """
        meet = next((at for at in range(lo + 1, hi) if self.starts_unit(text, at)), None)
        out = {}
        if meet is not None:
            last_unit = next(at for at in range(hi - 1, lo, -1) if self.starts_unit(text, at))
            tail = self.exits(text, last_unit, hi, self.paths(text[last_unit:hi], NONE))
            for back, piece in self.entries(text, lo):
                if meet - lo + back in self.paths(text[lo - back : meet], piece, back + 1):
                    out |= {((back, piece), x): 0.0 for x in tail}
        else:
            for back, piece in self.entries(text, lo):
                for x in self.exits(text, lo - back, hi, self.paths(text[lo - back : hi], piece, back + 1)):
                    out[(back, piece), x] = 0.0
        return out

    def exits(self, text: str, at: int, hi: int, last: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
        found = []
        for e, (piece, _) in last.items():
            end = at + e
            if hi - self.longest < end <= hi:
                found.append((hi - end, NONE if end == 0 or self.starts_unit(text, end) else piece))
        return found


def combine(a: dict[tuple, float], b: dict[tuple, float]) -> dict[tuple, float]:
    """Max-plus product of two transfer matrices; associative."""
    by: dict[tuple, list] = {}
    for (x, y), w in b.items():
        by.setdefault(x, []).append((y, w))
    out: dict[tuple, float] = {}
    for (x, y), w in a.items():
        for z, v in by.get(y, ()):
            out[x, z] = max(out.get((x, z), float("-inf")), w + v)
    return out


def borders(matrices: list[dict[tuple, float]]) -> list[tuple[int, int]]:
    """The states of the best path at all borders, the start and the end of the text included."""
    prefixes = [{((0, NONE), (0, NONE)): 0.0}]
    for m in matrices:
        prefixes.append(combine(prefixes[-1], m))
    ends = {y: w for (_, y), w in prefixes[-1].items() if y[0] == 0}
    state = max(ends, key=lambda y: (ends[y], y))
    out = [state]
    for prefix, m in zip(reversed(prefixes[:-1]), reversed(matrices)):
        fits = {x: w + prefix[(0, NONE), x] for (x, y), w in m.items() if y == state and ((0, NONE), x) in prefix}
        state = max(fits, key=lambda x: (fits[x], x))
        out.append(state)
    return out[::-1]


_LOADED: dict[str, Pieces] = {}


def _pieces(proto: bytes) -> Pieces:
    """One vocabulary, with what it has learned, for each worker process."""
    key = hashlib.md5(proto).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(proto)
    return _LOADED[key]


def mark(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))


def _encode_giants(rows: DataFrame, proto: bytes, chunk: int) -> DataFrame:
    """(doc_id, ids) of rows whose texts are longer than a chunk."""
    rows = rows.withColumn("key", text_key())

    def cut(it):
        reach = 2 * _pieces(proto).longest
        for batch in it:
            for key, text in zip(batch.column(0), batch.column(1)):
                marked = mark(text.as_py())
                for n, lo in enumerate(range(0, len(marked), chunk)):
                    start = max(0, lo - reach)
                    # One character more shows whether a unit begins at the border.
                    one = [[key.as_py()], [n], [marked[start : lo + chunk + 1]], [lo - start], [min(chunk, len(marked) - lo)], [start == 0]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, (batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()))], ["key", "n", "text", "lo", "size", "whole"])

    texts = rows.dropDuplicates(["key"]).select("key", "text")
    chunks = texts.mapInArrow(cut, "key struct<a:bigint,b:bigint>, n int, text string, lo int, size int, whole boolean")
    chunks = cut_lineage(chunks.repartition("key", "n"), "chunks")

    def view(row: dict) -> tuple[str, int, int]:
        # Without the text's start, place 0 must not look like one.
        pad = "" if row["whole"] else "\x00"
        return pad + row["text"], row["lo"] + len(pad), row["lo"] + len(pad) + row["size"]

    def transfers(it):
        pieces = _pieces(proto)
        for batch in it:
            out = []
            for row in batch.to_pylist():
                m = pieces.transfer(*view(row))
                out.append([{"a": x[0], "b": x[1], "c": y[0], "d": y[1], "w": w} for (x, y), w in m.items()])
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32()), ("d", pa.int32()), ("w", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["key", "n", "matrix"])

    matrices = chunks.mapInArrow(transfers, "key struct<a:bigint,b:bigint>, n int, matrix array<struct<a:int,b:int,c:int,d:int,w:double>>")
    matrices = matrices.select("key.a", "key.b", "n", "matrix")

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        states = borders([{((e["a"], e["b"]), (e["c"], e["d"])): e["w"] for e in m} for m in rows["matrix"]])
        return pd.DataFrame({"a": rows["a"], "b": rows["b"], "n": rows["n"], "back": [s[0] for s in states[:-1]], "before": [s[1] for s in states[:-1]], "short": [s[0] for s in states[1:]]})

    path = matrices.groupBy("a", "b").applyInPandas(scan, "a bigint, b bigint, n int, back int, before int, short int")
    path = path.select(F.struct("a", "b").alias("key"), "n", "back", "before", "short")

    def backtrace(it):
        pieces = _pieces(proto)
        for batch in it:
            for a, b in slices(batch.column(2), _SLICE):
                part, out = batch.slice(a, b - a), []
                for row in part.to_pylist():
                    text, lo, hi = view(row)
                    out.append((text[lo - row["back"] : hi - row["short"]], row["before"], row["back"] + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _list_array(pieces.encode_many(out))], ["key", "n", "ids"])

    parts = chunks.join(path, ["key", "n"]).mapInArrow(backtrace, "key struct<a:bigint,b:bigint>, n int, ids array<int>")
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "ids"))).alias("parts"))
    whole = whole.select(F.col("key").alias("__key"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    return rows.join(whole, F.col("key") == F.col("__key")).select("doc_id", "ids")


def encode_documents(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) of every row: the ids that the model's own encoder gives to the whole text.

    Null and empty texts have no ids. Rows are independent, null ids and repeated rows stay, an empty table gives
    an empty one. Characters without a piece become bytes. A text longer than ``chunk`` is spread over tasks.
    """
    with open(model, "rb") as f:
        proto = f.read()

    def batches(it):
        pieces = _pieces(proto)
        for batch in it:
            for a, b in slices(batch.column(1), _SLICE):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), _list_array(pieces.encode_many([(mark(t), NONE, 1) for t in part.column(1).to_pylist()]))], ["doc_id", "ids"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    short = rows.filter(F.length("text") < chunk).mapInArrow(batches, f"doc_id {kind}, ids array<int>")
    return short.unionByName(_encode_giants(rows.filter(F.length("text") >= chunk), proto, chunk))


def decode_documents(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to an empty text. A space mark in the encoded text comes back as a space."""
    with open(model, "rb") as f:
        proto = f.read()

    def batches(it):
        pieces = _pieces(proto)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(_ids(x)) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def _ids(cell) -> list[int]:
    return cell.values.to_numpy().tolist() if cell.is_valid else []


def code_digests(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_bytes, decoded_sha256): ids as little-endian 32-bit numbers, and the text read back from them."""
    with open(model, "rb") as f:
        proto = f.read()

    def batches(it):
        pieces = _pieces(proto)
        for batch in it:
            out = []
            for cell in batch.column(1):
                ids = _ids(cell)
                text = pieces.decode(ids).encode()
                out.append((len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), len(text), hashlib.sha256(text).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_bytes", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(batches, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_bytes long, decoded_sha256 string")
