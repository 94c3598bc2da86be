"""LM scoring by masked pseudo-likelihood.

A window network predicts every word from its neighbours on both sides, the word itself being hidden, and a
document's score is the sum of the words' conditional log-probabilities. A word is known by its class (a
frequent word's own, or one of a number of hashed ones) and, within a hashed class, by its hash bucket.
The network sees contexts of classes, so the corpus enters the fit through counts of (left, word, right)
classes over all documents: training on them is training on every position of every text. Model and
counts have a fixed size, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .kernel import U, as_bytes, range_hashes, slices, word_spans

#: Words with a class of their own; classes altogether, the last of them the edge of a text; buckets of other words.
FREQUENT, CLASSES, BUCKETS = 96, 128, 1 << 16
EDGE = CLASSES - 1
DIM, STEPS, RATE, SEED = 32, 150, 0.03, 17


@dataclass(frozen=True)
class Vocabulary:
    """Hashes of the frequent words, ascending, and each bucket's log-probability within its class."""

    frequent: np.ndarray
    within: np.ndarray

    def classes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and the log-probability of its bucket within the class."""
        bucket = (hashes >> U(48)).astype(np.int64)
        kind = FREQUENT + bucket % (EDGE - FREQUENT)
        within = self.within[bucket]
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            own = self.frequent[at] == hashes
            kind, within = np.where(own, at, kind), np.where(own, 0.0, within)
        return kind, within


def _words(texts: pa.Array):
    """Per slice: from, to, hashes of words, first word of each text."""
    for a, b in slices(texts):
        data, offsets = as_bytes(texts.slice(a, b - a))
        starts, ends, first = word_spans(data, offsets)
        yield a, b, range_hashes(data, starts, ends), first


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of each word's hash in all texts."""

    def batches(it):
        for batch in it:
            for _, _, hashes, _ in _words(batch.column(0)):
                values, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(batches, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The vocabulary of all texts; the driver gets FREQUENT words and BUCKETS counts."""
    counts = cut_lineage(word_counts(docs), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT)
    frequent = np.sort(np.array([r["word"] for r in top.collect()], np.int64).view(U))
    rest = counts.join(F.broadcast(top.select("word")), "word", "left_anti")  # FREQUENT rows
    found = rest.groupBy(F.shiftrightunsigned("word", 48).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    n = np.ones(BUCKETS)  # a word not seen so far is possible
    n[found["bucket"].to_numpy()] += found["n"].to_numpy()
    kind = np.arange(BUCKETS) % (EDGE - FREQUENT)
    return Vocabulary(frequent, np.log(n / np.bincount(kind, n)[kind]))


def contexts(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of each word's context: left class times CLASSES plus right class."""
    left, right = np.full(len(kinds), EDGE), np.full(len(kinds), EDGE)
    left[1:], right[:-1] = kinds[:-1], kinds[1:]
    starts = first[:-1][np.diff(first) > 0]
    left[starts] = EDGE
    right[starts[1:] - 1] = EDGE
    return left * CLASSES + right


def context_counts(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(context, kind, n): how often each class stands in each context, over all texts."""

    def batches(it):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in it:
            for _, _, hashes, first in _words(batch.column(0)):
                if len(hashes):
                    kinds, _ = vocab.classes(hashes)
                    values, n = np.unique(contexts(kinds, first) * CLASSES + kinds, return_counts=True)
                    total[values] += n
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            ids = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((ids // CLASSES).astype(np.int32)), pa.array((ids % CLASSES).astype(np.int32)), pa.array(total[ids])], ["context", "kind", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(batches, "context int, kind int, n long")
    return rows.groupBy("context", "kind").agg(F.sum("n").alias("n"))


def fit(counts: np.ndarray, dim: int = DIM, steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """Log-probabilities of each class in each context, from a network with one hidden layer.

    ``counts`` is (contexts, classes). The hidden layer adds a vector for the left and one for the right
    neighbour; the output is a softmax over classes without the edge. Adam on the mean loss over all counted positions.
    """
    rng = np.random.default_rng(seed)
    left, right = np.divmod(np.arange(CLASSES**2), CLASSES)
    p = {"l": rng.normal(0, 0.3, (CLASSES, dim)), "r": rng.normal(0, 0.3, (CLASSES, dim)), "w": rng.normal(0, 0.1, (dim, EDGE)), "b": np.log(counts.sum(0)[:EDGE] + 1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moment, spread = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    c = counts[:, :EDGE].astype(np.float32)
    seen = np.flatnonzero(c.sum(1) > 0)
    c, l, r = c[seen], left[seen], right[seen]
    n = c.sum(1, keepdims=True)
    total = max(1.0, float(n.sum()))

    def forward(l, r):
        h = np.tanh(p["l"][l] + p["r"][r])
        z = h @ p["w"] + p["b"]
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def by_class(at, rows):
        out = np.zeros((CLASSES, dim), np.float32)
        order = np.argsort(at, kind="stable")
        ids, start = np.unique(at[order], return_index=True)
        out[ids] = np.add.reduceat(rows[order], start, axis=0)
        return out

    for step in range(1, steps + 1) if len(seen) else ():
        h, logp = forward(l, r)
        d = (np.exp(logp) * n - c) / total
        dh = (d @ p["w"].T) * (1 - h * h)
        g = {"w": h.T @ d, "b": d.sum(0), "l": by_class(l, dh), "r": by_class(r, dh)}
        for k in p:
            moment[k] = 0.9 * moment[k] + 0.1 * g[k]
            spread[k] = 0.99 * spread[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8)
    out = np.zeros((CLASSES**2, CLASSES), np.float32)
    for at in range(0, len(left), 4096):
        out[at : at + 4096, :EDGE] = forward(left[at : at + 4096], right[at : at + 4096])[1]
    return out


def train(docs: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and log-probability table of all texts. The driver gets at most CLASSES cubed counts."""
    vocab = vocabulary(docs)
    found = context_counts(docs, vocab).toArrow()
    counts = np.zeros((CLASSES**2, CLASSES))
    counts[found["context"].to_numpy(), found["kind"].to_numpy()] = found["n"].to_numpy()
    return vocab, fit(counts)


def score(docs: DataFrame, model: tuple[Vocabulary, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, score, mean_score) of every row.

    A text without words, null ones too, has score 0 and a null mean. One row per input row: null ids and repeated rows stay.
    """
    vocab, table = model

    def batches(it):
        for batch in it:
            for a, b, hashes, first in _words(batch.column(1)):
                kinds, within = vocab.classes(hashes)
                logp = table[contexts(kinds, first), kinds] + within
                n, total = np.diff(first), np.zeros(b - a)
                some = n > 0
                if some.any():
                    total[some] = np.add.reduceat(logp.astype(np.float64), first[:-1][some])
                mean = pa.array(np.divide(total, n, out=np.zeros(b - a), where=some), mask=~some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(total), mean], ["doc_id", "n_tokens", "score", "mean_score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double, mean_score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Trains on all of ``docs`` and scores each of its rows; other columns than doc_id and text do not matter."""
    return score(docs, train(docs))
