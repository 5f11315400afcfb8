"""Vectorised word tools shared by the text operators of this subpackage.

Every function works on one Arrow string column as a flat UTF-8 byte buffer plus document offsets, so a
whole batch is cut into words, hashed and windowed by a handful of numpy passes instead of a Python loop
over words.  Both word definitions in use are byte classes (every byte of a non-ASCII character is at or
above 0x80), so working on UTF-8 bytes gives exactly the words that the character classes describe.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, every other byte unchanged.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Every byte unchanged.
AS_IS = _BYTES
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, a-z and everything outside ASCII (after lower-casing).
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: ``[^\x20\x09-\x0D]``: everything but ASCII white space.
NONSPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Runs of letters and digits, and runs of other signs, as words of their own.
WORDS_AND_SIGNS = np.where(ALNUM, 1, np.where(NONSPACE & (_BYTES > 0x20), 2, 0)).astype(np.uint8)

#: Bytes of text handled by one numpy pass; a longer document is a pass of its own.
SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


@dataclass
class Words:
    """Words of some documents: byte spans, hashes and the first word of each document (one more at the end)."""

    text: np.ndarray  # lower-cased bytes, padded with 8 zero bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.text[self.starts[i] : self.ends[i]].tobytes()

    def hashes(self) -> np.ndarray:
        return span_hashes(self.text, self.starts, self.ends)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    h = (h ^ (h >> _S32)) * _M2
    h = (h ^ (h >> _S29)) * _M1
    return h ^ (h >> _S32)


def span_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: eight bytes at a time, only the longer spans in later rounds."""
    eights = np.ndarray((max(len(text) - 7, 0),), dtype="<u8", buffer=text.data, strides=(1,))
    left = (ends - starts).astype(np.int64)
    h = mix(left.astype(np.uint64) * _M1)
    at, live = starts, None
    while len(at):
        x = eights[at] & _MASKS[np.minimum(left, 8)]
        if live is None:
            h = mix((h ^ x) * _M1)
        else:
            h[live] = mix((h[live] ^ x) * _M1)
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``limit`` bytes together, at least one document each."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def split(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray = ALNUM, fold: np.ndarray = LOWER) -> Words:
    """Cut documents (bytes ``raw``, offsets ``offs`` from 0) into runs of one non-zero byte class, each byte replaced by ``fold``."""
    text = np.zeros(len(raw) + 8, np.uint8)
    np.take(fold, raw, out=text[: len(raw)])
    inside = kind[text[: len(raw)]].view(np.uint8)
    border = np.ones(len(raw) + 1, bool)  # before each byte, and at the end
    np.not_equal(inside[1:], inside[:-1], out=border[1:-1])
    border[offs] = True  # a word never runs over the end of its document
    starts = np.flatnonzero(border[:-1] & (inside != 0))
    ends = np.flatnonzero(border[1:] & (inside != 0)) + 1
    return Words(text, starts, ends, np.searchsorted(starts, offs))


def batch_words(batch: pa.RecordBatch, name: str, kind: np.ndarray = ALNUM) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for successive row runs of a batch."""
    raw, offs = column(batch, name)
    for a, b in slices(offs):
        yield a, b, split(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], kind)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` successive word hashes (runs over document ends included)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = h * _M2 + hashes[k : k + size]
    return mix(h)


def window_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window index, document) of every window of ``n`` words that lies inside one document."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    base = np.cumsum(counts) - counts
    return np.arange(len(doc)) - base[doc] + first[:-1][doc], doc
