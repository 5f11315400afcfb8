"""Order-preserving packing of documents into fixed-length training sequences (operator 8).

Documents become token ids (a ``tokenizers`` file, then an end id each) and are laid one after the other in the
order in which Spark reads them.  Cuts between sequences are chosen by dynamic programming over the places where
a cut may fall: document ends (free), sentence ends (a small penalty), and any other token (a larger one; such
places are only offered one sequence length after the last better place, so that no stretch is too long).  With
``f[j]`` the least cost of the tokens before place ``j``::

    f[j] = penalty[j] + min over i with 0 < x[j] - x[i] <= length of  f[i] + padding(x[j] - x[i])

Padding is ``length - n``, so the minimum is that of ``f[i] + x[i]`` over a sliding window: a monotone queue
gives every transition in amortised constant time.  A sequence whose token count is a power of two needs no
padding; those few exact distances are looked up besides.

Every partition packs its own documents block by block (``BLOCK`` tokens; the last cut of a block is only taken
once its successors are known, the tail moves on to the next block), so memory does not depend on the partition's
size, nothing is shuffled, and a lost task repeats its own partition with the same result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm._spark import field, long
from docloom.llm.tokencount import byte_letters

#: Token places of one dynamic program.
BLOCK = 1 << 18
#: White space in a row that the rank table's pattern takes: it steps back over a run sign by sign and runs out of stack at some 700,000.
LONGEST_RUN = 100_000
#: How byte-level vocabularies cut text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of texts as the ``tokenizers`` file gives them.

    Where the file is a plain byte-level BPE whose ids are in merge order, the same vocabulary runs as a rank table
    (several times faster, equal ids); texts that hold a special string or white space of more than ``LONGEST_RUN`` signs
    in a row, and other files, go through the library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = self._ranks(spec)
        size = self.tokenizer.get_vocab_size()
        ends = [self.tokenizer.decode([k], skip_special_tokens=False).rstrip(" \"')") for k in range(size)]
        #: Whether a sentence or line may end after a token.
        self.sentence_end = np.array([x[-1:] in ".!?\n" and x != "" for x in ends])

    @staticmethod
    def _ranks(spec: dict):
        import tiktoken

        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or model.get("end_of_word_suffix") or model.get("ignore_merges") or made != sorted(set(made)):
            return None
        byte = {c: b for b, c in enumerate(byte_letters())}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in x): k for x, k in model["vocab"].items()}, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not (self.special and "<" in text and self.special.search(text)) and not _long_run(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def _long_run(text: str) -> bool:
    return len(text) > LONGEST_RUN and any(m.end() - m.start() > LONGEST_RUN for m in _SPACES.finditer(text))


_SPACES = re.compile(r"\s+")
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def places(doc_ends: np.ndarray, soft: np.ndarray, length: int, penalties: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut places (from 0) and their penalties: document ends, sentence ends, and fillers every ``length`` in longer gaps."""
    x = np.union1d(np.concatenate([[0], doc_ends]), soft)
    cost = np.where(np.isin(x, doc_ends), 0.0, penalties[0])
    gaps = np.diff(x)
    wide = np.flatnonzero(gaps > length)
    if len(wide):
        more = np.concatenate([np.arange(x[i] + length, x[i + 1], length) for i in wide])
        x, cost = np.concatenate([x, more]), np.concatenate([cost, np.full(len(more), penalties[1])])
        order = np.argsort(x, kind="stable")
        x, cost = x[order], cost[order]
    cost[0] = 0.0
    return x, cost


def choose_cuts(x: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Indices into ``x`` of the cheapest cuts from the first to the last place (both included)."""
    n = len(x)
    at, pen = x.tolist(), cost.tolist()
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    exact = {}  # place -> index of the place exactly a power of two before it
    for p in powers:
        k = np.searchsorted(x, x - p)
        hit = np.flatnonzero((k < n) & (x[np.minimum(k, n - 1)] == x - p) & (x >= p))
        for j, i in zip(hit.tolist(), k[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(at[0]), 0)])
    for j in range(1, n):
        low = at[j] - length
        while at[queue[0][1]] < low:
            queue.popleft()
        key, i = queue[0]
        best = key + length - at[j]
        for e in exact.get(j, ()):
            if f[e] < best:
                best, i = f[e], e
        f[j], back[j] = best + pen[j], i
        key = f[j] + at[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class Packer:
    """Packs one partition's documents; ``add`` and ``close`` give the pieces that are settled."""

    def __init__(self, length: int, penalties: tuple[float, float], sentence_end: np.ndarray, keep_ids: bool = False) -> None:
        self.length, self.penalties, self.sentence_end, self.keep_ids = length, penalties, sentence_end, keep_ids
        self.docs: deque[list] = deque()  # key, ids, ids already packed
        self.size, self.sequence = 0, 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([key, ids, 0])
        self.size += len(ids)
        if self.size >= BLOCK:
            yield from self._pack(last=False)

    def close(self) -> Iterator[tuple]:
        if self.size:
            yield from self._pack(last=True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        ids = np.concatenate([d[1][d[2] :] for d in self.docs])
        ends = np.cumsum([len(d[1]) - d[2] for d in self.docs])
        x, cost = places(ends, np.flatnonzero(self.sentence_end[ids]) + 1, self.length, self.penalties)
        cuts = choose_cuts(x, cost, self.length)
        if not last and len(cuts) > 9:
            cuts = cuts[:-8]  # the last cuts may change with what follows
        for a, b in zip(x[cuts[:-1]].tolist(), x[cuts[1:]].tolist(), strict=True):
            offset = 0
            while offset < b - a:
                key, doc, done = self.docs[0]
                take = min(len(doc) - done, b - a - offset)
                piece = doc[done : done + take]
                yield key, done, take, zlib.crc32(piece.tobytes()), len(doc), self.sequence, offset, piece if self.keep_ids else None
                offset += take
                self.docs[0][2] += take
                if done + take == len(doc):
                    self.docs.popleft()
            self.sequence += 1
            self.size -= b - a


def pack(
    docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 0, penalties: tuple[float, float] = (8.0, 64.0),
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` tokens.

    Columns: id, ``start`` (tokens of the document before the piece), ``length``, ``ids_crc32`` (of its little-endian
    unsigned 32-bit ids), ``doc_tokens`` (with the end id), ``sequence_id`` (unique over all partitions), ``offset``
    (place in the sequence, gapless from 0) and, with ``with_ids``, ``ids``.  ``penalties`` are the costs, in padded
    tokens, of a cut at a sentence end and of one inside a sentence.

    A null or empty text is its end id alone; repeated rows and null ids are packed like any other row; a document
    longer than a sequence is cut; an empty table gives an empty result; other columns are not read.  Texts of any
    length are encoded whole, one at a time (white space, words or numbers of millions of signs too), in memory that
    grows with the longest text; cuts of equal cost are chosen alike at every run.
    """
    schema = [field(docs, id_col), long("start"), long("length"), long("ids_crc32"), long("doc_tokens"), long("sequence_id"), long("offset")]
    if with_ids:
        schema.append(T.StructField("ids", T.ArrayType(T.LongType())))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        packer = Packer(length, penalties, encode.sentence_end, with_ids)
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")
        key_type = None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            arrays = [pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(np.array(cols[5]) + base), pa.array(cols[6], pa.int64())]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in cols[7]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                out += packer.add(key, ids)
                if len(out) >= 10_000:
                    yield flush()
        out += packer.close()
        if out:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(schema))
