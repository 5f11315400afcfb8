"""Token counts by heap-and-linked-list byte-pair merging (operator 9).

The count of a word is the number of its initial symbols minus the number of merges: a heap holds the ranks of
all adjacent pairs, the lowest rank (leftmost on ties) is popped, its two symbols become one in a linked list,
and the two new neighbour pairs are pushed.  No identifiers are emitted.  The vocabulary is a ``tokenizers``
JSON file of a BPE model with word-end suffix and lower-casing normaliser; nothing is trained.

Texts are cut at white space first: no rule of such a file looks across white space, so counts of equal
stretches are equal and a bounded per-worker memo serves the repeated ones.  Whole texts are counted.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docloom.llm._spark import boolean, field, long, map_batches

#: White space as the Unicode property has it; Python's own notion also has 0x1C to 0x1F.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = regex.compile("[\x1c-\x1f]")
_STRETCH = regex.compile(f"[^{SPACE}]+")
#: Entries of a worker's memo before it starts anew.
MEMO = 400_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stays, the rest moves to 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        parts = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(next(p for p in parts if p["type"] == "Split")["pattern"]["Regex"].replace(r"\s", SPACE))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.by_piece: dict[str, int] = {}
        self.by_stretch: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Symbols left of one piece once no adjacent pair has a rank."""
        symbols = [self.letters[b] for b in piece.encode("utf-8")]
        symbols[-1] += self.suffix
        n = left = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((a + b, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbols[k]))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], a + b))
        return left

    def plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
        total = 0
        for piece in self.pieces.findall(text):
            if (n := self.by_piece.get(piece)) is None:
                n = self.merged(piece)
                if len(piece) <= 64:
                    if len(self.by_piece) >= MEMO:
                        self.by_piece.clear()
                    self.by_piece[piece] = n
            total += n
        return total

    def stretch(self, text: str) -> int:
        """Count of a text without white space; each special string is one token."""
        total = at = 0
        for m in self.special.finditer(text) if self.special and "<" in text else ():
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])

    def count(self, text: str) -> int:
        stretches = _STRETCH.findall(text) if _ODD.search(text) else text.split()
        memo = self.by_stretch
        try:
            return sum(map(memo.__getitem__, stretches))
        except KeyError:
            pass
        total = 0
        for s in stretches:
            if (n := memo.get(s)) is None:
                n = self.stretch(s)
                if len(s) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[s] = n
            total += n
        return total


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per vocabulary and worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Texts and words of any length are counted whole (a word of n symbols in some n log n steps).  Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows are counted each; an empty
    table gives an empty result; other columns of ``docs`` are not read.  ``vocabulary`` is a path that every
    executor can open (the file belongs to an installed package).
    """

    def each(batch: pa.RecordBatch):
        texts = batch.column(1).fill_null("")
        sizes = np.asarray(pa.compute.binary_length(texts.cast(pa.large_binary())))
        count = counter(vocabulary).count
        tokens = np.fromiter((count(x.as_py()) for x in texts), np.int64, batch.num_rows)
        yield {id_col: batch.column(0), "n_bytes": sizes.astype(np.int64), "n_tokens": tokens, "over_limit": tokens > limit}

    return map_batches(docs.select(id_col, text_col), [field(docs, id_col), long("n_bytes"), long("n_tokens"), boolean("over_limit")], each)
