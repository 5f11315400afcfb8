"""Quality classifier: hashed word n-gram logistic regression, learnt by FTRL-proximal updates (operator 10).

A document is the bag of its word 1- and 2-grams (runs of letters and digits, and runs of other signs, are words),
hashed into ``2 ** bits`` features with value ``sqrt(count / all)``, which gives every document unit length.
Learning follows the regularised leader one example at a time (per-coordinate rates, L1 and L2), on a bounded
sample (``max_rows``) of labelled documents; the sample's sparse features are made on the executors.  Scoring is a
sparse dot product with the broadcast weights (8 * 2 ** bits bytes) per document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import _training, _words
from docloom.llm._spark import double, field, filter_batches, integer, map_batches

BITS = 18
#: Bound of the learning sample.
MAX_ROWS = 6000
#: The feature of 2-grams that are one word twice.
SAME_WORD = 0x155


def features(text: _words.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every 1- and 2-gram; a 2-gram of one word twice also counts as the 2-gram "same word"."""
    h = text.hashes()
    docs, keys = [], []
    for n in (1, 2):
        ix, doc = _words.window_starts(text.first, n)
        keys.append((_words.windows(h, n)[ix] >> np.uint64(64 - bits)).astype(np.int64))
        docs.append(doc)
    same = h[ix] == h[ix + 1]
    docs.append(doc[same])
    keys.append(np.full(int(same.sum()), SAME_WORD & ((1 << bits) - 1)))
    return np.concatenate(docs), np.concatenate(keys)


def bags(text: _words.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' distinct features and values: (start of each document, features, values)."""
    doc, key = features(text, bits)
    both, counts = np.unique((doc << bits) | key, return_counts=True)
    owner = both >> bits
    n = len(text.first) - 1
    totals = np.bincount(doc, minlength=n)
    return np.searchsorted(owner, np.arange(n + 1)), both & ((1 << bits) - 1), np.sqrt(counts / totals[owner])


@dataclass
class Ftrl:
    """FTRL-proximal logistic regression; ``bias`` is a feature of its own with value 1 and no L1."""

    bits: int = BITS
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 10, seed: int = 7) -> tuple[np.ndarray, float]:
        size = 1 << self.bits
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)).tolist():
                key, value, y = rows[i]
                key, value = np.append(key, size), np.append(value, 1.0)
                w = self.weights(z[key], n[key], key == size)
                p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
                g = (p - y) * value
                step = (np.sqrt(n[key] + g * g) - np.sqrt(n[key])) / self.alpha
                z[key] += g - step * w
                n[key] += g * g
        w = self.weights(z, n, np.arange(size + 1) == size)
        return w[:-1], float(w[-1])

    def weights(self, z: np.ndarray, n: np.ndarray, free: np.ndarray) -> np.ndarray:
        l1 = np.where(free, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights and bias, learnt from at most ``max_rows`` labelled documents outside the held-out fold (zeros without any).

    The sample's sparse features reach the driver: its memory is bounded by ``max_rows`` times the distinct 1- and 2-grams
    of a document, at most ``2 ** bits``.
    """

    def each(batch: pa.RecordBatch):
        ids, y = batch.column(0), batch.column(2)
        for a, b, text in _words.batch_words(batch, "text", _words.WORDS_AND_SIGNS):
            start, key, value = bags(text, bits)
            cuts = start.astype(np.int32)
            yield {
                "_id": ids.slice(a, b - a), "y": y.slice(a, b - a),
                "key": pa.ListArray.from_arrays(pa.array(cuts), pa.array(key.astype(np.int32))), "value": pa.ListArray.from_arrays(pa.array(cuts), pa.array(value.astype(np.float32))),
            }

    chosen = _training.sample(docs, labels, label, max_rows, id_col, text_col)
    out = [field(chosen, "_id"), integer("y"), T.StructField("key", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))]
    rows = map_batches(chosen, out, each).orderBy(F.xxhash64("_id"), "_id", "key").select("key", "value", "y").toArrow()  # at most max_rows
    values = lambda name: (x.values.to_numpy(zero_copy_only=False) for x in rows.column(name))
    return Ftrl(bits).fit(list(zip(values("key"), values("value"), rows.column("y").to_pylist(), strict=True)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """One row per row of ``docs``: id and ``score``, the probability of label 1.

    Null and empty texts get the bias alone; null ids stay null; repeated rows score alike; an empty table gives an
    empty result; texts of any length are scored whole; other columns are not read.
    """
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def each(batch: pa.RecordBatch):
        for a, b, text in _words.batch_words(batch, text_col, _words.WORDS_AND_SIGNS):
            yield {id_col: batch.column(0).slice(a, b - a), name: scores(text, shared.value, bias, bits)}

    return map_batches(docs.select(id_col, text_col), [field(docs, id_col), double(name)], each)


def scores(text: _words.Words, weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    start, key, value = bags(text, bits)
    n = len(text.first) - 1
    dots = np.bincount(np.repeat(np.arange(n), np.diff(start)), weights[key] * value, n)
    return 1 / (1 + np.exp(-np.clip(dots + bias, -35, 35)))


def keep(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float, bits: int = BITS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``; a model without examples removes nothing; otherwise as ``score``."""
    weights, bias = model
    if not bias and not weights.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def mask(batch: pa.RecordBatch) -> list[bool]:
        return [x >= threshold for _, _, text in _words.batch_words(batch, text_col, _words.WORDS_AND_SIGNS) for x in scores(text, shared.value, bias, bits).tolist()]

    return filter_batches(docs, mask)
