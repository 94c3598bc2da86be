"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document.

Fitting sees a bounded sample of labelled rows in one task. Because the output is linear in the average,
a document's margin is the mean of one learned number per feature: scoring streams over whole texts
with a table of fixed size, sums per document and never builds vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from .kernel import U, as_bytes, mix, range_hashes, slices, word_spans

BITS = 18
DIM = 8
#: Labelled rows used to fit, at most; those with the least hashes of their ids.
SAMPLE = 4000
EPOCHS, RATE, SEED = 5, 0.4, 13
THRESHOLD = 0.3
_C = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)]


def features(texts: pa.Array):
    """Hashed features: words, pairs of neighbouring words, and runs of 3 and 4 characters.

    Yields (from, to, kinds) per slice of texts; a kind is (ids, where each text begins in them, items in a run).
    A pair is hashed by exclusive or, so a word said twice is the same feature whatever the word.
    """
    shift = U(64 - BITS)
    for a, b in slices(texts, 1 << 20):
        data, offsets = as_bytes(texts.slice(a, b - a))
        starts, ends, first = word_spans(data, offsets)
        words = range_hashes(data, starts, ends)
        kinds = [((words >> shift).astype(np.int64), first, 1), ((mix_fast(words[1:] ^ words[:-1]) >> shift).astype(np.int64), first, 2)]
        heads = (data & 0xC0) != 0x80  # bytes that begin a character
        at = np.concatenate(([0], np.cumsum(heads)))[offsets]
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(U)
        rolled = points * _C[0]
        for n in (2, 3, 4):
            rolled = rolled[: max(0, len(points) - n + 1)] + points[n - 1 :] * _C[n - 1] if len(points) >= n else rolled[:0]
            if n > 2:
                ids = (mix_fast(rolled) >> shift).astype(np.int64)
                kinds.append((ids, at, n))
        yield a, b, kinds


def mix_fast(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * _C[1]
    return x ^ (x >> U(29))


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    lo, hi = np.minimum(lo, len(values)), np.minimum(hi, len(values))
    return total[np.maximum(hi, lo)] - total[lo]


def margins(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """Mean of the table's numbers over each text's features, plus the bias; a text without features has the bias."""
    out = np.full(len(texts), bias)
    for a, b, kinds in features(texts):
        total, count = np.zeros(b - a), np.zeros(b - a, np.int64)
        for kind in kinds:
            ids, first, n = kind
            lo, hi = first[:-1], first[1:] - (n - 1)  # no run leaves its text
            total += _sums(table[ids], lo, hi)
            count += np.maximum(hi - lo, 0)
        out[a:b] += np.where(count > 0, total / np.maximum(count, 1), 0.0)
    return out


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one text and their shares."""
    parts = []
    for _, _, kinds in features(pa.array([text], pa.string())):
        for kind in kinds:
            parts.append(kind[0])
    ids, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0))
    return ids, (n / max(1, n.sum())).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on the softmax loss of both classes; returns one number per feature, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    bags, steps, done = [bag(t) for t in texts], epochs * max(1, len(texts)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            seen = vectors[ids]
            mean = share @ seen
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            # Shares are small; the step is scaled by the number of distinct features.
            vectors[ids] = seen - (lr * len(ids)) * share[:, None] * back
    w = out[:, 1] - out[:, 0]
    return (vectors @ w).astype(np.float32), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality, text) of at most ``sample`` labelled documents outside the held-out fifth."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Bounded by the limit above, so small enough for every executor.
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").filter("text is not null")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The fitted table and bias; zeros if no labelled document is found. One task holds the bounded sample."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"]).head(2 * sample)
        table, bias = fit(list(rows["text"]), rows["quality"].to_numpy(np.int64))
        return pd.DataFrame({"table": [table.tobytes()], "bias": [bias]})

    found = training_rows(docs, labels, sample).groupBy().applyInPandas(run, "table binary, bias double").collect()
    if not found:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(found[0]["table"], np.float32), found[0]["bias"]


def quality_score(model: tuple[np.ndarray, float]):
    """A function of a text column: the probability of label 1."""
    table, bias = model

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-margins(texts.cast(pa.string()), table, bias))))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A null or empty text has no features and gets the bias's score; a null id is never held out. Rows with
    one id and different texts have scores of their own. Labels other than 0 and 1 and null ids teach nothing; of several labels of one
    document the largest counts. Without labels every score is 0.5. Other columns of ``docs`` do not matter.
    """
    score = quality_score(train(docs, labels, sample))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    score = quality_score(train(docs, labels, sample))
    return docs.filter(score("text") >= threshold)
