"""URL filters by a sorted digest array (operator 3).

A rule is (host, path, verdict): it fits its host and all subdomains where the url's path starts with the rule's.
Rules are kept as a file: 64-bit xxhash keys of ``host + path`` in ascending order, then the full strings.  The file
lies in the shared folder, from which Spark hands a copy to every executor, and is memory-mapped by its Python workers (one copy per machine in the page cache) and probed
with a vectorised binary search for all candidates (host suffixes x path prefixes of the lengths in use) of a
batch; every key hit is confirmed against the stored string, so colliding keys cannot give a wrong verdict.

The array has a checked size: a table of more than ``max_rules`` rules or ``max_bytes`` of their strings stays a table
and the candidates are joined with it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm._spark import Workspace, field, map_batches, string

#: Rules in one array file and bytes of their strings: on the driver, which sorts them, some 200 MB in all; the file itself has 21 bytes a rule more.
MAX_RULES, MAX_BYTES = 500_000, 32 << 20
_ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_MAGIC = b"digests1"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def array_bytes(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """Digest file of distinct (host, path, verdict): header, keys, string offsets, host lengths, verdicts, strings.

    Of contradicting rules with the same host and path the blocking one counts.
    """
    best: dict[tuple[bytes, bytes], bool] = {}
    for host, start, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        key = (host.translate(_ASCII).encode(), start.encode())
        best[key] = best.get(key, False) or verdict == "block"
    order = sorted((xxhash.xxh64_intdigest(h + p), h + p, len(h), b) for (h, p), b in best.items())
    n = len(order)
    strings = [s for _, s, _, _ in order]
    return b"".join((
        _MAGIC, struct.pack("<q", n), np.array([k for k, *_ in order], "<u8").tobytes(), np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype("<i8").tobytes(),
        np.array([h for _, _, h, _ in order], "<i4").tobytes(), np.array([b for *_, b in order], "u1").tobytes(), *strings, b"\0",
    ))


class DigestArray:
    """A memory-mapped digest file."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError(f"{path} is no digest array")
        n = struct.unpack("<q", raw[8:16].tobytes())[0]
        at = 16
        parts = []
        for kind, size in (("<u8", 8 * n), ("<i8", 8 * n + 8), ("<i4", 4 * n), ("u1", n)):
            parts.append(np.ndarray((size // np.dtype(kind).itemsize,), kind, buffer=raw.data, offset=at))
            at += size
        self.keys, self.offsets, self.hosts, self.block = parts
        self.strings, self.raw = raw[at:], raw
        self.path_lengths, self.host_lengths = np.unique(np.diff(self.offsets) - self.hosts).tolist(), np.unique(self.hosts).tolist()

    def find(self, candidates: list[tuple[bytes, int]]) -> np.ndarray:
        """Index of the rule with each (string, host length), or -1."""
        out = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return out
        keys = np.fromiter((xxhash.xxh64_intdigest(s) for s, _ in candidates), np.uint64, len(candidates))
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(high > low).tolist():
            text, host = candidates[i]
            for k in range(int(low[i]), int(high[i])):
                if self.hosts[k] == host and self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == text:
                    out[i] = k
        return out


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a url: host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then the path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    cut = min(ends, default=len(rest))
    path = rest[cut:]
    stop = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:cut].translate(_ASCII), path[:stop]


def candidates(host: str, path: str, host_lengths: list[int], path_lengths: list[int]) -> list[tuple[bytes, int]]:
    """Strings that a fitting rule may have: every run of last labels of the host, and prefix of the path, whose length in bytes some rule has."""
    if not host and not path:
        return []
    h, p = host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass")
    ends = [h[len(h) - n :] for n in host_lengths if n == len(h) or n < len(h) and h[len(h) - n - 1] == 0x2E]
    return [(x + p[:n], len(x)) for x in ends for n in path_lengths if n <= len(p)]


_ARRAYS: dict[str, DigestArray] = {}


def _array(name: str) -> DigestArray:
    path = SparkFiles.get(name)
    if path not in _ARRAYS:
        _ARRAYS[path] = DigestArray(path)
    return _ARRAYS[path]


_SENT: set[tuple[str, str]] = set()


def _send(spark: SparkSession, data: bytes) -> str:
    """Hands the file to all executors, once per application and content; returns its name."""
    name = f"digests-{xxhash.xxh3_128_hexdigest(data)}.bin"
    if (sent := (spark.sparkContext.applicationId, name)) not in _SENT:
        spark.sparkContext.addFile(Workspace(spark, "urlfilter").write_bytes(data, name))
        _SENT.add(sent)
    return name


def filter_urls(
    pages: DataFrame, rules: Iterable[Rule] | DataFrame, default: str = "allow", max_rules: int = MAX_RULES, max_bytes: int = MAX_BYTES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` (host and path of the longest fitting rule, else null), ``verdict``.

    ``rules`` is a list or a table (host, path, verdict); null fields count as empty, a null verdict as block.  Longest
    means most UTF-8 bytes of host and path together, then the longer host.  Without a fitting rule the verdict is
    ``default``.  A null url, or one without ``://``, has an empty host and path, which no rule fits.  Repeated rows
    and null ids are judged like others; urls of any length are judged whole; an empty rule list leaves all to
    ``default``; an empty table of pages gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        table = rules.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path")), F.coalesce("verdict", F.lit("block")).alias("verdict")).distinct()
        n, size = table.agg(F.count("*"), F.sum(F.octet_length("host") + F.octet_length("path"))).first()
        if n > max_rules or (size or 0) > max_bytes:
            return _joined(pages, table, default, id_col, url_col)
        found = table.toArrow()  # within the two bounds
        listed = zip(*(found.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True)
    else:
        listed = [(r.host or "", r.path or "", r.verdict or "block") for r in rules]
    name = _send(spark, array_bytes(listed))

    def each(batch: pa.RecordBatch):
        array = _array(name)
        split = [parts(u) for u in batch.column(1).to_pylist()]
        each_row = [candidates(h, p, array.host_lengths, array.path_lengths) for h, p in split]
        flat = [c for row in each_row for c in row]
        found = array.find(flat)
        rule, verdict, at = [None] * len(split), [default] * len(split), 0
        for i, row in enumerate(each_row):
            fits = [k for k in found[at : at + len(row)].tolist() if k >= 0]
            at += len(row)
            if fits:
                k = max(fits, key=lambda k: (array.offsets[k + 1] - array.offsets[k], array.hosts[k]))
                rule[i] = array.strings[array.offsets[k] : array.offsets[k + 1]].tobytes().decode()
                verdict[i] = "block" if array.block[k] else "allow"
        yield {id_col: batch.column(0), "host": [h for h, _ in split], "path": [p for _, p in split], "rule": pa.array(rule, pa.string()), "verdict": verdict}

    return map_batches(pages.select(id_col, url_col), [field(pages, id_col), string("host"), string("path"), string("rule"), string("verdict")], each)


def _joined(pages: DataFrame, table: DataFrame, default: str, id_col: str, url_col: str) -> DataFrame:
    """The way beyond the bound: candidates of distinct urls joined with the rules by string."""
    work = Workspace(pages.sparkSession, "urlfilter")
    table = work.write(
        table.withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules"
    )
    lengths = [[r[0] for r in table.select(F.octet_length(c).alias("n")).distinct().collect()] for c in ("host", "path")]  # lengths, not rules

    def each(batch: pa.RecordBatch):
        out = []
        for u in batch.column(0).to_pylist():
            for c, n in candidates(*parts(u), *lengths):
                try:  # a prefix that ends inside a character is no rule's path
                    host, path = c[:n].decode(), c[n:].decode()
                except UnicodeDecodeError:
                    continue
                out.append((u, host, path))
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield {n: pa.array(c, pa.string()) for n, c in zip(("_url", "host", "path"), cols, strict=True)}

    distinct = pages.select(F.col(url_col).alias("_url")).distinct()
    tried = map_batches(distinct, [string(n) for n in ("_url", "host", "path")], each)
    size = F.octet_length("host") + F.octet_length("path")
    fit = tried.join(table, ["host", "path"]).groupBy("_url").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct(size, F.octet_length("host"))).alias("best"))

    def split_each(batch: pa.RecordBatch):
        split = [parts(u) for u in batch.column(1).to_pylist()]
        yield {id_col: batch.column(0), "_url": batch.column(1), "host": [h for h, _ in split], "path": [p for _, p in split]}

    rows = map_batches(pages.select(id_col, F.col(url_col).alias("_url")), [field(pages, id_col), string("_url"), string("host"), string("path")], split_each)
    return rows.join(fit, "_url", "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
