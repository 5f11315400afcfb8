"""Benchmark decontamination with a broadcast hash set of normalised test n-grams (operator 6).

Texts and benchmark items are normalised to lower-case words.  A window is ``n`` consecutive words of an item; an
item of fewer words is one window.  The windows' hashes are broadcast as a sorted array (with the items that hold
each window and the window's real words), documents are scanned with vectorised rolling window hashes, every hash
hit is verified word by word, and the words inside verified windows are marked.

The broadcast has a checked size: above ``max_windows`` windows or ``max_bytes`` of their words they stay distributed
and each document's window hashes are joined with them instead (one shuffle; same results).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import _words
from docloom.llm._spark import Workspace, boolean, field, fresh, filter_batches, long, map_batches, string

#: Windows that may be broadcast, and bytes of their words: with what Python adds some 60 MB in the driver and in each worker.
MAX_WINDOWS, MAX_BYTES = 100_000, 16 << 20
_SLOT = np.uint64(44)


@dataclass
class WindowSet:
    """Windows of benchmark items, by length: sorted hashes, their words and items."""

    by_length: dict[int, tuple[np.ndarray, list[list[tuple[bytes, str]]]]]

    def __post_init__(self) -> None:
        self._slots: dict[int, np.ndarray] | None = None

    def __getstate__(self):
        return {"by_length": self.by_length, "_slots": None}

    def slots(self, n: int) -> np.ndarray:
        """A bit per hash prefix: most windows of a text are dismissed by one table lookup."""
        if self._slots is None:
            self._slots = {}
            for m, (keys, _) in self.by_length.items():
                self._slots[m] = np.zeros(1 << 20, bool)
                self._slots[m][(keys >> _SLOT).astype(np.int64)] = True
        return self._slots[n]


def item_windows(items: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (n, window hash, words joined by a space, item) of all items; items without words have none."""

    def each(batch: pa.RecordBatch):
        ids = batch.column(0).cast(pa.string()).to_pylist()
        rows = []
        for a, _, w in _words.batch_words(batch, text_col):
            h = w.hashes()
            for k, (s, e) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                if e > s and ids[a + k] is not None:
                    size = min(n, e - s)
                    keys = _words.windows(h[s:e], size).view(np.int64).tolist()
                    rows += {(size, key, b" ".join(w.word(i) for i in range(s + i0, s + i0 + size)), ids[a + k]) for i0, key in enumerate(keys)}
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield {"size": pa.array(cols[0], pa.int64()), "key": pa.array(cols[1], pa.int64()), "words": pa.array(cols[2], pa.binary()).cast(pa.string()), "item": pa.array(cols[3], pa.string())}

    return map_batches(items.select(item_col, text_col), [long("size"), long("key"), string("words"), string("item")], each).distinct()


def window_set(rows) -> WindowSet:
    grouped: dict[int, dict[int, list[tuple[bytes, str]]]] = {}
    for r in rows:
        grouped.setdefault(r["size"], {}).setdefault(r["key"] & (2**64 - 1), []).append((r["words"].encode(), r["item"]))
    return WindowSet({n: (np.array(sorted(g), np.uint64), [sorted(g[k]) for k in sorted(g)]) for n, g in grouped.items()})


def _scan(text: _words.Words, against: WindowSet) -> tuple[np.ndarray, list[set[str]]]:
    """(hit words, items by document) of documents against a window set."""
    hashes = text.hashes()
    hit = np.zeros(len(hashes) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(text.first) - 1)]
    for n, (keys, known) in against.by_length.items():
        h = _words.windows(hashes, n)
        maybe = np.flatnonzero(against.slots(n)[(h >> _SLOT).astype(np.int64)])
        at = np.searchsorted(keys, h[maybe])
        real = keys[np.minimum(at, len(keys) - 1)] == h[maybe]
        for i, k in zip(maybe[real].tolist(), at[real].tolist(), strict=True):
            doc = int(np.searchsorted(text.first, i, side="right")) - 1
            if i + n > text.first[doc + 1]:
                continue
            words = b" ".join(text.word(j) for j in range(i, i + n))
            same = [item for w, item in known[k] if w == words]
            if same:
                items[doc].update(same)
                hit[i] += 1
                hit[i + n] -= 1
    return np.cumsum(hit)[:-1] > 0, items


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_clean_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: what it shares with the benchmark.

    Columns: id, ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items`` (items with occurring
    windows), ``item_ids`` (those, sorted as strings, comma-joined), ``items_sha256`` (hex digest of that),
    ``contaminated`` (any hit) and, with ``with_clean_text``, ``clean_text``: the text without the hit words and what
    stands between successive ones (null where the text is null).

    Null and empty texts have no words and no hits; items with null id or without words have no windows; repeated
    documents and items count like others (``n_items`` counts distinct ids); an empty benchmark contaminates nothing.
    Texts of any length are scanned whole, a long one in a pass of its own; other columns are not read.
    """
    shared, work, found = _windows(docs, benchmark, n, max_windows, max_bytes, item_col, item_text_col)
    if shared is None:
        return _distributed(docs, found, work, id_col, text_col, with_clean_text)
    source = docs.select(id_col, text_col)
    out = _fields(docs, id_col, with_clean_text)

    def each(batch: pa.RecordBatch):
        for a, b, text in _words.batch_words(batch, text_col):
            hit, items = _scan(text, shared.value)
            yield _columns(batch, a, b, text, hit, items, id_col, with_clean_text)

    return map_batches(source, out, each)


def keep(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, without contaminated ones; otherwise as ``decontaminate``."""
    shared, work, found = _windows(docs, benchmark, n, max_windows, max_bytes, item_col, item_text_col)
    if shared is None:
        row = fresh(docs, "_row")
        keyed = work.write(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
        hits = _hits(keyed.select(F.col(row).alias("_row"), text_col), found, text_col)
        return keyed.join(hits.select(F.col("_row").alias(row)), row, "left_anti").select(docs.columns)

    def mask(batch: pa.RecordBatch) -> list[bool]:
        out = []
        for _, _, text in _words.batch_words(batch, text_col):
            hit, _ = _scan(text, shared.value)
            totals = np.concatenate([[0], np.cumsum(hit)])
            out += (totals[text.first[1:]] == totals[text.first[:-1]]).tolist()
        return out

    return filter_batches(docs, mask)


def _windows(docs: DataFrame, benchmark: DataFrame, n: int, max_windows: int, max_bytes: int, item_col: str, item_text_col: str) -> tuple:
    """(broadcast window set, -, -) within the bound, else (None, workspace, written windows)."""
    spark = docs.sparkSession
    found = item_windows(benchmark, n, item_col, item_text_col)
    count, size = found.agg(F.count("*"), F.sum(F.octet_length("words"))).first()
    if count > max_windows or (size or 0) > max_bytes:
        work = Workspace(spark, "decontaminate")
        return None, work, work.write(found, "windows")
    return spark.sparkContext.broadcast(window_set(found.toArrow().to_pylist())), None, None  # within the two bounds


def _fields(docs: DataFrame, id_col: str, with_clean_text: bool) -> list:
    out = [field(docs, id_col), long("n_words"), long("n_hit"), long("n_items"), string("item_ids"), string("items_sha256"), boolean("contaminated")]
    return [*out, string("clean_text")] if with_clean_text else out


def _columns(batch: pa.RecordBatch, a: int, b: int, text: _words.Words, hit: np.ndarray, items: list[set[str]], id_col: str, with_clean_text: bool) -> dict:
    totals = np.concatenate([[0], np.cumsum(hit)])
    n_hit = totals[text.first[1:]] - totals[text.first[:-1]]
    joined = [",".join(sorted(x)) for x in items]
    cols = {
        id_col: batch.column(0).slice(a, b - a),
        "n_words": text.counts,
        "n_hit": n_hit,
        "n_items": [len(x) for x in items],
        "item_ids": joined,
        "items_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in joined],
        "contaminated": n_hit > 0,
    }
    if with_clean_text:
        cols["clean_text"] = pa.array([_clean(batch.column(1)[a + k].as_py(), text, hit, k) if n_hit[k] else batch.column(1)[a + k].as_py() for k in range(b - a)], pa.string())
    return cols


def _clean(text: str, words: _words.Words, hit: np.ndarray, k: int) -> str:
    """The text without runs of hit words."""
    raw, (s, e) = text.encode(), words.first[k : k + 2]
    base = int(words.starts[s]) - _first_word_at(raw)
    flags = hit[s:e]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    out, at = [], 0
    for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(raw[at : int(words.starts[s + i]) - base])
        at = int(words.ends[s + j - 1]) - base
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def _first_word_at(raw: bytes) -> int:
    return int(np.flatnonzero(_words.ALNUM[_words.LOWER[np.frombuffer(raw, np.uint8)]])[0])


def _distributed(docs: DataFrame, found: DataFrame, work: Workspace, id_col: str, text_col: str, with_clean_text: bool) -> DataFrame:
    """The way beyond the broadcast bound: documents' window hashes meet the windows in a join, verified words and all.

    Each document row gets a row number key; only (key, item, place) hits come back to it.
    """
    keyed = work.write(docs.select(id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "docs")
    hits = _hits(keyed, found, text_col)
    joined = keyed.join(hits, "_row", "left").select(id_col, text_col, F.col("hits.at").alias("at"), F.col("hits.size").alias("size"), F.col("hits.item").alias("item"))

    def each(batch: pa.RecordBatch):
        at, size, item = (batch.column(i).to_pylist() for i in (2, 3, 4))
        for a, b, text in _words.batch_words(batch, text_col):
            marks = np.zeros(len(text.starts) + 1, np.int64)
            items: list[set[str]] = []
            for k in range(a, b):
                items.append(set(item[k] or ()))
                for i, n in zip(at[k] or (), size[k] or (), strict=True):
                    marks[text.first[k - a] + i] += 1
                    marks[text.first[k - a] + i + n] -= 1
            yield _columns(batch, a, b, text, np.cumsum(marks)[:-1] > 0, items, id_col, with_clean_text)

    return map_batches(joined, _fields(docs, id_col, with_clean_text), each)


def _hits(keyed: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """(_row, hits): the windows that stand in each row's text; hashes meet in a join, what meets is checked word by word."""
    sizes = [r["size"] for r in found.select("size").distinct().collect()]  # at most n values

    def grams(batch: pa.RecordBatch):
        rows = batch.column(0)
        for a, _, w in _words.batch_words(batch, text_col):
            h = w.hashes()
            for size in sizes:
                ix, doc = _words.window_starts(w.first, size)
                yield {"_row": rows.slice(a).take(pa.array(doc)), "size": np.full(len(ix), size), "key": _words.windows(h, size)[ix].view(np.int64), "at": ix - w.first[:-1][doc]}

    seen = map_batches(keyed.select("_row", text_col), [long("_row"), long("size"), long("key"), long("at")], grams)
    maybe = seen.join(found, ["size", "key"]).groupBy("_row").agg(F.collect_set(F.struct("at", "size", "item", "words")).alias("maybe"))
    hit = T.StructField("hits", T.ArrayType(T.StructType([long("at"), long("size"), string("item")])))

    def verify(batch: pa.RecordBatch):
        for a, b, w in _words.batch_words(batch, text_col):
            out = []
            for k in range(a, b):
                s = int(w.first[k - a])
                out.append([{"at": m["at"], "size": m["size"], "item": m["item"]} for m in batch.column(2)[k].as_py() if b" ".join(w.word(s + m["at"] + i) for i in range(m["size"])) == m["words"].encode()])
            yield {"_row": batch.column(0).slice(a, b - a), "hits": pa.array(out, pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64()), ("item", pa.string())])))}

    return map_batches(keyed.join(maybe, "_row").select("_row", text_col, "maybe"), [long("_row"), hit], verify).where(F.size("hits") > 0)
