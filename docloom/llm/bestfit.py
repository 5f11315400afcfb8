"""Best-fit packing by a configuration linear program over the length histogram (operator 13).

Documents become token ids (a ``tokenizers`` file, then an end id each); only a document longer than a sequence is cut,
into whole sequences and a rest.  How the pieces go together is decided on the histogram of their lengths alone, which has
at most ``length`` entries however many documents there are:

* A *configuration* is a multiset of lengths that fits one sequence.  The program asks for amounts ``x`` of configurations
  that hold every piece, with the least sum of amounts.
* It is solved by multiplicative weights, in passes.  Each length has a price, at first its share of a sequence (in later passes
  its mean price of the pass before), that is multiplied by ``exp(-rate * gain)`` as the part of its pieces that have found a place gains on the mean.
  Knapsack dynamic programming finds, for every length that still lacks a place, the dearest configuration that holds it; those
  as dear as the dearest of all, but for a tolerance, are taken in steps that no length can be overfilled by.
* Amounts are rounded: configurations that leave more room than the mean are given up, the others have their whole copies
  first, then one copy more of the largest remainders while their pieces last.  Pieces still left go into the
  fullest sequence that has room, longest piece first (all copies of a configuration at once, so this too works on the histogram).

Spark numbers the pieces of every length without bringing a length together: a task counts its own pieces of every length,
a running sum over tasks places each task, and the plan (configurations, copies, offsets) turns (length, number) into sequence and
offset by arithmetic.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import _words
from docloom.llm._spark import Workspace, field, hinted, integer, long
from docloom.llm.packing import encoder
from docloom.llm.tokencount import SPACE, byte_letters

#: Configurations of a round, how much less than the dearest they may be worth, and the part of all tokens that is left to rounding.
PER_ROUND, TOLERANCE, SLACK = 256, 5e-4, 0.15
#: (how much dearer a late length gets, part of a length's pieces that a step may place) of each pass over the program; a pass begins
#: with the mean prices of the one before, and is the last if its plan needs at most ``NEAR`` more sequences than full ones would be.
PASSES, NEAR = ((0.1, 0.5), (1.0, 0.1), (1.0, 0.1), (1.0, 0.1)), 3e-4
#: Slots of a worker's memo (40 bytes each) and the ids that it may gather before it starts anew.
SLOTS, IDS = 1 << 20, 1 << 23
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Stands for the word end in the rank table.
WORD_END = "\x01"
#: Below this code point letters and digits are listed, which is quicker than asking for their class.
NARROW = 0x250


class Ids:
    """Unsigned 32-bit ids of texts, as the ``tokenizers`` file gives them.

    Where no rule of the file looks across white space (it drops white space, marks word ends and normalises sign by sign),
    equal stretches between white space have equal ids: those met before come from a memo in arrays, looked up a megabyte
    of text at a time.  The others are joined by line ends, normalised and cut into pieces together, and merged in a rank
    table of the same vocabulary in which a mark stands for the word end; a line end is a piece whose one id tells where a
    stretch ends.  Stretches with special strings or the mark go through the library; so does every text under any other
    kind of file, by ``packing.encoder``.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.table = self._ranks(spec)
        self.whole = None if self.table else encoder(path)
        self.forget()
        if self.table:
            self.odd = regex.compile("|".join(map(regex.escape, [WORD_END, *(t["content"] for t in spec["added_tokens"])])))
            pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE) + "|\n"
            self.pieces = regex.compile(pieces)
            kinds = {k: "".join(re.escape(c) for c in map(chr, range(NARROW)) if regex.match(rf"\p{{{k}}}", c)) for k in "LN"}
            self.narrow = re.compile(pieces.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]))
            self.line = self.table.encode_ordinary("\n" + WORD_END)[0]

    @staticmethod
    def _ranks(spec: dict):
        """The rank table of a vocabulary whose ids are bytes, bytes at word ends, then merges in their order; else None."""
        import tiktoken

        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        apart = [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        if not plain or not apart or not end or model.get("ignore_merges") or any(t["normalized"] or regex.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            return None
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if made != list(range(512, 512 + len(made))) or {model["vocab"][c + e] for c in letters for e in ("", end)} != set(range(512)):
            return None
        mark = WORD_END.encode()
        ranks = {bytes(byte[c] for c in x.removesuffix(end)) + mark * x.endswith(end): k for x, k in model["vocab"].items() if k < 512 + len(made)}
        return tiktoken.Encoding("ranks", pat_str=f"[^{WORD_END}]*{WORD_END}", mergeable_ranks=ranks, special_tokens={})

    def of_batch(self, batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of every row of a batch; null counts as empty."""
        if self.table is None:
            for k, text in enumerate(batch.column(name)):
                yield k, self.whole(text.as_py() or "")
            return
        raw, offs = _words.column(batch, name)
        for a, b in _words.slices(offs):
            cut = _words.split(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], _words.NONSPACE, _words.AS_IS)
            first, count = self.places(cut)
            ends = np.concatenate([[0], np.cumsum(count)])
            ids = self.ids[_runs(first, count, ends)]
            cuts = ends[cut.first]
            for k in range(a, b):
                yield k, ids[cuts[k - a] : cuts[k - a + 1]]
            if self.used > IDS:
                self.forget()

    def forget(self) -> None:
        self.ids, self.used = np.zeros(1 << 20, "<u4"), 0
        self.keys, self.sizes = np.zeros((SLOTS, 2), np.uint64), np.zeros(SLOTS, np.uint8)
        self.first, self.count = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)

    def places(self, cut: _words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of every stretch.

        A stretch of at most 16 bytes is its own key, two machine words and a length; it may lie in one of two slots.
        """
        size = cut.ends - cut.starts
        eights = np.ndarray((len(cut.text) - 7,), dtype="<u8", buffer=cut.text.data, strides=(1,))
        low = eights[cut.starts] & _MASKS[np.minimum(size, 8)]
        high = eights[np.minimum(cut.starts + 8, len(eights) - 1)] & _MASKS[np.clip(size - 8, 0, 8)]
        slot = (_words.mix(_words.mix(low) + high + size.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        known = np.zeros(len(size), bool)
        for other in (slot, slot ^ 1):
            fits = (self.keys[other, 0] == low) & (self.keys[other, 1] == high) & (self.sizes[other] == size) & ~known
            slot = np.where(fits, other, slot)
            known |= fits
        first, count = self.first[slot], self.count[slot]
        miss = np.flatnonzero(~known)
        if len(miss):
            ends = np.concatenate([[0], np.cumsum(size[miss] + 1)])
            joined = cut.text[_runs(cut.starts[miss], size[miss] + 1, ends)]
            joined[ends[1:] - 1] = 10
            stretches = joined.tobytes().decode().split("\n")[:-1]
            own = {x: k for k, x in enumerate(dict.fromkeys(stretches))}
            which = np.fromiter(map(own.__getitem__, stretches), np.int64, len(miss))
            where, many = self._add(list(own))
            first[miss], count[miss] = where[which], many[which]
            short = miss[size[miss] <= 16]
            at = slot[short]
            at = np.where((self.sizes[at] > 0) & (self.sizes[at ^ 1] == 0), at ^ 1, at)
            at, once = np.unique(at, return_index=True)
            short = short[once]
            self.keys[at, 0], self.keys[at, 1], self.sizes[at] = low[short], high[short], size[short]
            self.first[at], self.count[at] = first[short], count[short]
        return first, count

    def _add(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes stretches; the place and number of the ids of each."""
        text = "\n".join([*stretches, ""])
        odd = [k for k, x in enumerate(stretches) if self.odd.search(x)] if self.odd.search(text) else []
        if odd:
            text = "\n".join(["" if self.odd.search(x) else x for x in stretches] + [""])
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()  # only sigma looks at its neighbours
        pieces = (self.pieces if max(text) >= chr(NARROW) else self.narrow).findall(text)
        flat = np.array(self.table.encode_ordinary(WORD_END.join([*pieces, ""])), "<u4")
        lines = np.flatnonzero(flat == self.line)
        ends = lines - np.arange(len(lines))
        flat = flat[flat != self.line]
        own = {k: np.array(self.tokenizer.encode(stretches[k], add_special_tokens=False).ids, "<u4") for k in odd}
        extra = np.cumsum([0, *(len(x) for x in own.values())]) + len(flat)
        flat = np.concatenate([flat, *own.values()])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        first = np.concatenate([[0], ends[:-1]])
        count = ends - first
        for j, k in enumerate(odd):
            first[k], count[k] = extra[j], extra[j + 1] - extra[j]
        self.used += len(flat)
        return first + (self.used - len(flat)), count


def _runs(first: np.ndarray, count: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of every run, one run after the other; ``ends`` are the running sums of the counts from 0."""
    return np.repeat(first - ends[:-1], count) + np.arange(ends[-1])


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One encoder per vocabulary and worker process."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def priced(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the dearest filling of every capacity from 0, and the index of the size that it begins with (-1: nothing)."""
    best, first = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes[0]) if len(sizes) else capacity + 1, capacity + 1):
        n = int(np.searchsorted(sizes, room, side="right"))
        value = best[room - sizes[:n]] + prices[:n]
        k = int(value.argmax())
        if value[k] > 0:
            best[room], first[room] = value[k], k
    return best, first


def fractions(
    histogram: dict[int, int], capacity: int, rate: float, step: float, base: np.ndarray | None = None
) -> tuple[dict[tuple[tuple[int, int], ...], float], np.ndarray]:
    """Amounts of configurations, ((size, pieces), ...), that hold all but ``SLACK`` of the tokens of ``histogram``, and the mean prices of the sizes.

    ``base`` are the prices to begin with, by default each size's share of the capacity.
    """
    sizes = np.array(sorted(histogram))
    need = np.array([histogram[s] for s in sizes.tolist()], float)
    volume = need * sizes / (need * sizes).sum()
    base = sizes / capacity if base is None else base
    placed, paid = np.zeros(len(sizes)), np.zeros(len(sizes))  # part of each size's pieces; prices, by progress
    amounts: Counter = Counter()
    mean = 0.0
    while mean < 1 - SLACK:
        at = np.flatnonzero(placed < 1)
        prices = base * np.exp(rate * (mean - placed))
        best, first = priced(sizes[at], prices[at], capacity)
        value = prices[at] + best[capacity - sizes[at]]  # of the dearest configuration with each size
        dear = np.flatnonzero(value >= (1 - TOLERANCE) * value.max())
        for k in dear[np.argsort(placed[at[dear]], kind="stable")][:PER_ROUND].tolist():
            inside, room = Counter([k]), capacity - int(sizes[at[k]])
            while (j := int(first[room])) >= 0:
                inside[j] += 1
                room -= int(sizes[at[j]])
            own, many = at[list(inside)], np.array(list(inside.values()), float)
            left = (1 - placed[own]) * need[own]
            amount = float((np.minimum(left, step * need[own]) / many).min())
            if amount <= 0:
                continue  # an earlier one of this round has placed all pieces of one of its sizes
            placed[own] += amount * many / need[own]
            placed[own[placed[own] > 1 - 1e-9]] = 1
            amounts[tuple(sorted((int(sizes[at[j]]), n) for j, n in inside.items()))] += amount
        before, mean = mean, float((placed * volume).sum())
        paid += (mean - before) * prices / value.max()
    return amounts, paid / mean


def fill(bins: list[list], left: dict[int, int], capacity: int) -> None:
    """Puts pieces into the fullest of ``bins`` that has room, longest first; ``bins`` are [contents, copies], changed in place."""
    free: dict[int, list[list]] = defaultdict(list)
    for b in bins:
        free[capacity - sum(s * n for s, n in b[0].items())].append(b)
    for size in sorted(left, reverse=True):
        todo, room = left[size], size
        while todo:
            while room <= capacity and not free.get(room):
                room += 1
            if room > capacity:
                each = capacity // size
                for many, copies in ((each, todo // each), (todo % each, 1)):
                    if many and copies:
                        bins.append(b := [Counter({size: many}), copies])
                        free[capacity - many * size].append(b)
                break
            b = free[room].pop()
            # every copy takes as many pieces as it has room for
            each = min(room // size, todo)
            copies = min(b[1], todo // each)
            if copies < b[1]:
                rest = [Counter(b[0]), b[1] - copies]
                bins.append(rest)
                free[room].append(rest)
                b[1] = copies
            b[0][size] += each
            free[room - each * size].append(b)
            todo -= each * copies


def rounded(amounts: dict[tuple[tuple[int, int], ...], float], histogram: dict[int, int], capacity: int) -> list[list]:
    """Sequences as [contents (size: pieces), copies] that hold every piece once, from amounts of configurations."""
    left, bins = dict(histogram), []

    def take(config: tuple[tuple[int, int], ...], copies: int) -> None:
        copies = min([copies, *(left[s] // n for s, n in config)])
        if copies:
            bins.append([Counter(dict(config)), copies])
            for s, n in config:
                left[s] -= n * copies

    room = {c: capacity - sum(s * n for s, n in c) for c in amounts}
    mean = sum(x * room[c] for c, x in amounts.items()) / sum(amounts.values())
    good = {c: x for c, x in amounts.items() if room[c] <= mean}
    for config, x in good.items():
        take(config, int(x))
    for config, _ in sorted(good.items(), key=lambda a: int(a[1]) - a[1]):
        take(config, 1)
    fill(bins, {s: n for s, n in left.items() if n}, capacity)
    return bins


def plan(histogram: dict[int, int], capacity: int) -> list[list]:
    """The best plan of the passes: [contents, copies] that hold every piece of ``histogram`` once."""
    if not histogram:
        return []
    least = sum(s * n for s, n in histogram.items()) / capacity
    best, needs, base = [], None, None
    for rate, step in PASSES:
        amounts, base = fractions(histogram, capacity, rate, step, base)
        bins = rounded(amounts, histogram, capacity)
        if needs is None or sum(c for _, c in bins) < needs:
            best, needs = bins, sum(c for _, c in bins)
        if needs < least * (1 + NEAR) + 1:
            break
    return best


class Lookup:
    """Where the n-th piece of a length goes, by the plan: arrays sorted by (length, first number)."""

    def __init__(self, bins: list[list]) -> None:
        rows, sequence, taken = [], 0, Counter()
        for contents, copies in bins:
            offset = 0
            for size in sorted(contents, reverse=True):
                many = contents[size]
                rows.append((size, taken[size], many, sequence, offset))
                taken[size] += many * copies
                offset += many * size
            sequence += copies
        size, self.start, self.many, self.sequence, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.stride = max(taken.values(), default=0) + 1
        self.key = size * self.stride + self.start

    def __call__(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        at = np.searchsorted(self.key, size * self.stride + number, side="right") - 1
        copy, place = np.divmod(number - self.start[at], self.many[at])
        return self.sequence[at] + copy, self.offset[at] + place * size


def pack(
    docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of a document in one of as few sequences of at most ``length`` tokens as the plan finds.

    Columns: id, ``piece`` (from 0), ``start`` (tokens of the document before the piece), ``length``, ``ids_crc32`` (of its
    little-endian unsigned 32-bit ids), ``sequence_id`` (from 0, without gaps), ``offset`` (place in the sequence,
    gapless from 0) and, with ``with_ids``, ``ids``.

    A null or empty text is its end id alone; repeated rows and null ids are packed like any other row; only a document
    longer than a sequence is cut, and its pieces may lie in any sequences; pieces of equal length are interchangeable, so which of them
    meet depends on the order in which Spark reads them; an empty table gives an empty result; other columns are not read.
    Texts of any length are encoded whole.
    """
    work = Workspace(docs.sparkSession, "bestfit")
    schema = [field(docs, id_col), integer("piece"), long("start"), long("length"), long("ids_crc32"), long("part"), long("number")]
    if with_ids:
        schema.append(T.StructField("ids", T.ArrayType(T.LongType())))
    types = [pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64())]
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, met = ids_of(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            keys, rows = [], []
            for k, own in encode.of_batch(batch, text_col):
                ids = np.concatenate([own, end])
                for j, at in enumerate(range(0, len(ids), length)):
                    piece = ids[at : at + length]
                    rows.append((j, at, n := len(piece), zlib.crc32(piece.astype("<u4").tobytes()), part, met[n], *([piece.astype(np.int64)] if with_ids else [])))
                    met[n] += 1
                    keys.append(k)
            if rows:
                columns = [batch.column(0).take(pa.array(keys)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    pieces = work.write(docs.select(id_col, text_col).mapInArrow(cut, T.StructType(schema)), "pieces")
    counts = work.write(pieces.groupBy("part", "length").agg(F.count("*").alias("many")), "counts")
    histogram = {r["length"]: r["many"] for r in counts.groupBy("length").agg(F.sum("many").alias("many")).collect()}  # at most ``length`` rows
    lookup = Lookup(plan(histogram, length))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = work.write(counts.select("part", "length", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before")), "starts")
    work.drop("counts")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = lookup(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            kept = [c for c in range(batch.num_columns) if batch.schema.names[c] != "number"]
            columns = [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[c] for c in kept), "sequence_id", "offset"])

    out = [f for f in schema if f.name not in ("part", "number")]
    numbered = pieces.join(hinted(starts), ["part", "length"]).select(*(f.name for f in out), (F.col("number") + F.col("before")).alias("number"))
    return numbered.mapInArrow(place, T.StructType([*out, long("sequence_id"), long("offset")]))
