"""Toxicity by averaged subword embeddings and a linear softmax (operator 7).

A word is the bag of its character 3- to 5-grams (with word borders) and itself, each hashed to a row of an
embedding matrix; a passage (``WIDTH`` successive distinct words of a document) is the average over its subwords, and
a linear softmax over the two classes reads that average.  A document scores as its worst passage, so a few bad words
weigh as much in a long text as in a short one.  Embeddings and softmax are learnt jointly in numpy (Adagrad) on a
bounded sample (``max_rows``), so misspelt and inflected words never seen in learning still share n-gram vectors with
known ones.

For scoring, the softmax of two classes over an average is linear in the rows of the embedding matrix: each row
shrinks to one number, which is broadcast (4 * 2 ** bits bytes), and every distinct word of a batch is summed up once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import _training, _words
from docloom.llm._spark import double, field, filter_batches, integer, map_batches, string

BITS, DIM = 17, 8
#: Distinct words of a passage.
WIDTH = 2
#: Bound of the learning sample.
MAX_ROWS = 6000
GRAMS = (3, 4, 5)


def subwords(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word, row) of every character n-gram of ``<word>`` and of the word itself."""
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    h = _words.mix(points + np.uint64(1))
    owner, rows = [], []
    for n in GRAMS:
        ix, word = _words.window_starts(first, n)
        owner.append(word)
        rows.append(_words.windows(h, n)[ix])
    place = np.arange(len(points), dtype=np.uint64) - np.repeat(first[:-1], sizes).astype(np.uint64)
    whole = np.add.reduceat(_words.mix(h + place * np.uint64(0x9E3779B97F4A7C15)), first[:-1]) if len(words) else np.zeros(0, np.uint64)
    owner.append(np.arange(len(words)))
    rows.append(_words.mix(whole))
    return np.concatenate(owner), (np.concatenate(rows) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_words(text: _words.Words) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Each document's distinct words in order of first occurrence: (start of each document, word, the words' texts)."""
    _, at, word = np.unique(text.hashes(), return_index=True, return_inverse=True)
    doc = text.doc_of()
    _, where = np.unique(doc * max(len(at), 1) + word, return_index=True)
    where.sort()
    first = np.searchsorted(doc[where], np.arange(len(text.first)))
    return first, word[where], [text.word(i).decode("utf-8", "replace") for i in at.tolist()]


def passages(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, document) of every stretch of ``width`` distinct words; the last of a document may be shorter."""
    many = -(-np.diff(first) // width)
    doc = np.repeat(np.arange(len(many)), many)
    return first[:-1][doc] + width * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)), doc


def averages(sums: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Average over the subwords of each passage, given its words' sums and numbers of subwords."""
    return np.add.reduceat(sums, starts) / np.add.reduceat(sizes, starts) if len(starts) else np.zeros(0)


def vocabulary_rows(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(embedding rows of all words one after the other, where each word's rows begin), a bounded stretch of words at a time."""
    rows, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for k in range(0, len(words), 1 << 14):
        owner, row = subwords(words[k : k + (1 << 14)], bits)
        rows.append(row[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner))
    return np.concatenate(rows), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def fit_softmax(
    docs: list[tuple[str, int]], bits: int = BITS, dim: int = DIM, width: int = WIDTH, epochs: int = 10, rate: float = 0.2, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Learns embeddings and softmax jointly from (distinct words joined by a space, label); returns each row's part of the class-1 logit, and the bias.

    A document stands for its worst passage under the model so far (in the first epoch, for a random one); documents
    of label 0 also for a random one.
    """
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (1 << bits, dim)) / dim
    w, b = np.zeros((2, dim)), np.zeros(2)
    w[1, :], w[0, :] = rng.uniform(0.5, 1, dim), -rng.uniform(0.5, 1, dim)
    ge, gw, gb = np.full(1 << bits, 1e-8), np.full((2, dim), 1e-6), np.full(2, 1e-6)
    if not docs:
        return np.zeros(1 << bits, np.float32), 0.0
    ids: dict[str, int] = {}
    own_words = [np.array([ids.setdefault(x, len(ids)) for x in words.split(" ")] if words else [], np.int32) for words, _ in docs]
    word = np.concatenate(own_words)
    row, cut = vocabulary_rows(list(ids), bits)
    sizes = np.diff(cut)
    first = np.concatenate([[0], np.cumsum([len(x) for x in own_words])])
    start, owner = passages(first, width)
    end, span = np.append(start[1:], len(word)), np.searchsorted(owner, np.arange(len(docs) + 1))
    for epoch in range(epochs):
        worst = averages(np.add.reduceat((e @ (w[1] - w[0]))[row], cut[:-1])[word], sizes[word], start) if len(word) else np.zeros(0)
        for i in rng.permutation(len(docs)).tolist():
            lo, hi, y = span[i], span[i + 1], docs[i][1]
            chosen = [lo + int(np.argmax(worst[lo:hi])) if epoch else int(rng.integers(lo, hi))] if hi > lo else [-1]
            if not y and hi > lo:
                chosen.append(int(rng.integers(lo, hi)))
            for p in chosen:
                rows = np.concatenate([row[cut[k] : cut[k + 1]] for k in word[start[p] : end[p]]]) if p >= 0 else row[:0]
                v = e[rows].mean(0) if len(rows) else np.zeros(dim)
                logits = w @ v + b
                d = np.exp(logits - logits.max())
                d /= d.sum()
                d[y] -= 1
                dv, dw = d @ w, np.outer(d, v)
                gw += dw * dw
                gb += d * d
                w -= 0.1 * rate * dw / np.sqrt(gw)
                b -= 0.1 * rate * d / np.sqrt(gb)
                if len(rows):
                    own, counts = np.unique(rows, return_counts=True)
                    g = (counts / len(rows))[:, None] * dv
                    ge[own] += (g * g).mean(1)
                    e[own] -= rate * g / np.sqrt(ge[own])[:, None]
    return (e @ (w[1] - w[0])).astype(np.float32), float(b[1] - b[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """The model, learnt from at most ``max_rows`` labelled documents outside the held-out fold (zeros without any).

    Distinct words of whole documents are listed on the executors; those of the sample reach the driver, so its memory
    is bounded by ``max_rows`` times the distinct words of a document.
    """

    def each(batch: pa.RecordBatch):
        for a, b, text in _words.batch_words(batch, "text"):
            first, word, words = distinct_words(text)
            yield {
                "_id": batch.column(0).slice(a, b - a), "y": batch.column(2).slice(a, b - a),
                "words": pa.array([" ".join(words[k] for k in word[s:e].tolist()) for s, e in zip(first[:-1], first[1:], strict=True)], pa.string()),
            }

    chosen = _training.sample(docs, labels, label, max_rows, id_col, text_col)
    made = map_batches(chosen, [field(chosen, "_id"), integer("y"), string("words")], each).orderBy(F.xxhash64("_id"), "_id", "words").select("words", "y")
    rows = made.toArrow()  # at most max_rows
    return fit_softmax(list(zip(rows.column("words").to_pylist(), rows.column("y").to_pylist(), strict=True)), bits)


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """One row per row of ``docs``: id and ``score``, the probability of label 1.

    Texts without words (null and empty ones too) get the bias alone; null ids stay null; repeated rows score alike;
    an empty table gives an empty result; texts of any length are scored whole; other columns are not read.
    """
    values, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(values)

    def each(batch: pa.RecordBatch):
        for a, b, text in _words.batch_words(batch, text_col):
            yield {id_col: batch.column(0).slice(a, b - a), name: scores(text, shared.value, bias, bits)}

    return map_batches(docs.select(id_col, text_col), [field(docs, id_col), double(name)], each)


def scores(text: _words.Words, values: np.ndarray, bias: float, bits: int = BITS, width: int = WIDTH) -> np.ndarray:
    first, word, words = distinct_words(text)
    owner, row = subwords(words, bits)
    sums, sizes = np.bincount(owner, values[row], len(words)), np.bincount(owner, minlength=len(words))
    start, doc = passages(first, width)
    logits = np.full(len(first) - 1, -np.inf)
    np.maximum.at(logits, doc, averages(sums[word], sizes[word], start))
    return 1 / (1 + np.exp(-np.clip(np.where(np.isinf(logits), 0.0, logits) + bias, -35, 35)))


def keep(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float, bits: int = BITS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; a model without examples removes nothing; otherwise as ``score``."""
    weights, bias = model
    if not bias and not weights.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def mask(batch: pa.RecordBatch) -> list[bool]:
        return [x < threshold for _, _, text in _words.batch_words(batch, text_col, _words.ALNUM) for x in scores(text, shared.value, bias, bits).tolist()]

    return filter_batches(docs, mask)
