"""Array kernels over batches of texts: words, their 64-bit hashes and rolling n-gram hashes.

A batch is taken as its UTF-8 bytes; nothing here loops over words or characters in Python.
A hash of a range is a difference of two prefix sums of a polynomial over the ring of 64-bit
integers, shifted back to exponent zero and mixed, so any range costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 18
SLICE_BYTES = 4 << 20
_BASE, _WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, near ones are spread."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * _BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = U(pow(int(self.base), -1, 1 << 64))
            for name, b in (("up", self.base), ("down", inverse)):
                a = np.full(size, b, U)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(_BASE), Powers(_WORD_BASE)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, one row at least."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, len(texts))
        at = min(to, len(texts))


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and where each one starts, with the end of the last."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+`` and each text's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[0] = after[-1] = True
    before[edges] = True
    after[edges - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; ranges ascend and do not overlap."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        lo, hi = starts[at], ends[to - 1]
        up, down = _BYTES.to(int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(_BYTE[data[lo:hi]] * up[:-1], out=total[1:])
        s = starts[at:to] - lo
        out[at:to] = (total[ends[at:to] - lo] - total[s]) * down[s]
        at = to
    return mix(out)


class Grams:
    """Hashes of runs of consecutive items of one long sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = _WORDS.to(len(values) + 1)
        self.total = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=self.total[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts])

    def all(self, n: int) -> np.ndarray:
        """The runs of ``n`` items from each place on, as far as they go."""
        return mix((self.total[n:] - self.total[: len(self.total) - n]) * self.down[: len(self.total) - n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)
