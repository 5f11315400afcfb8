"""License scans by template-markup matching (operator 4).

A license notice is a template: its words must stand in the text exactly, apart from two kinds of marked regions::

    <<beginOptional>> words <<endOptional>>      may be there or not
    <<var;name=holder;min=0;max=6>>              any words, at least min and at most max

Each template becomes an automaton over words (letters in lower case, punctuation ignored), made deterministic
state by state as texts need it.  Matching starts only where the first mandatory words of some template stand,
which one vectorised pass over word hashes finds (the automaton then reads the real words, so a hash collision
cannot match), and takes the longest accepted stretch from each start.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field as data_field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm import _words
from docloom.llm._spark import double, field, long, map_batches, string

_MARK = re.compile(r"<<(beginOptional|endOptional|var)(?:;([^>]*))?>>")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ANY = ""


@dataclass(frozen=True)
class Template:
    """``base`` templates are plain phrases whose every place is counted."""

    label: str
    text: str
    base: bool = False


BASE = (Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True))

NOTICES = (
    Template("apache", "licensed under the apache license <<beginOptional>>version <<var;name=version;min=1;max=2>><<endOptional>>"),
    Template("mit", "<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this <<var;name=kind;min=1;max=3>> and associated documentation files"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc <<beginOptional>><<var;name=version;min=1;max=2>><<endOptional>>"),
    Template("cc-by-sa", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by sa <<beginOptional>><<var;name=version;min=1;max=2>><<endOptional>>"),
    Template("gpl-notice", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu <<beginOptional>><<var;name=kind;min=1;max=1>><<endOptional>> general public license <<beginOptional>>version <<var;name=version;min=1;max=1>><<endOptional>>"),
    Template("copyright", "copyright <<beginOptional>>c<<endOptional>> <<var;name=holder;min=1;max=8>> all rights reserved"),
)

# Whole license texts and notices; what holders, projects and versions may fill in is marked.
_NO_WARRANTY_BSD = (
    "this software is provided by <<var;name=provider;min=1;max=12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose "
    "are disclaimed in no event shall <<var;name=provider;min=1;max=12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
    "or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of "
    "the use of this software even if advised of the possibility of such damage"
)
_BSD_2 = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
TEXTS = (
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this <<var;name=kind;min=1;max=3>> and associated documentation files the <<var;name=kind;min=1;max=3>> to deal in the <<var;name=kind;min=1;max=3>> "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the <<var;name=kind;min=1;max=3>> and to permit persons to whom the "
        "<<var;name=kind;min=1;max=3>> is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all "
        "copies or substantial portions of the <<var;name=kind;min=1;max=3>> the <<var;name=kind;min=1;max=3>> is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the <<var;name=holders;min=1;max=8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the <<var;name=kind;min=1;max=3>> or the use or other dealings in the <<var;name=kind;min=1;max=3>>",
    ),
    Template("bsd-2-clause", _BSD_2 + _NO_WARRANTY_BSD),
    Template(
        "bsd-3-clause",
        _BSD_2 + "<<beginOptional>>3<<endOptional>> neither the name of <<var;name=holder;min=1;max=10>> nor the names of <<var;name=whose;min=1;max=3>> contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission " + _NO_WARRANTY_BSD,
    ),
    Template(
        "isc",
        "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in "
        "all copies the software is provided as is and <<var;name=author;min=1;max=8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall "
        "<<var;name=author;min=1;max=8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this software",
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this <<var;name=kind;min=1;max=3>> except in compliance with the license you may obtain a copy of the license at "
        "<<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
        "as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    *(
        Template(
            label,
            f"is free software you can redistribute it and or modify it under the terms of the gnu {kind} as published by the free software foundation either version <<var;name=version;min=1;max=2>> of the license or at your option "
            "any later version <<var;name=program;min=1;max=8>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the "
            f"gnu {kind} for more details",
        )
        for label, kind in (("gpl-text", "general public license"), ("lgpl-text", "lesser general public license"), ("agpl-text", "affero general public license"))
    ),
    Template("cc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution <<beginOptional>>noncommercial<<endOptional>> <<beginOptional>>noderivatives<<endOptional>> "
             "<<beginOptional>>sharealike<<endOptional>> <<var;name=version;min=2;max=2>> <<beginOptional>><<var;name=place;min=1;max=2>><<endOptional>> license"),
)


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_ASCII))


@dataclass
class Automaton:
    """A word automaton of one template: non-deterministic states, deterministic ones built on demand."""

    template: Template
    steps: list[list[tuple[str, int]]] = data_field(default_factory=lambda: [[]])
    free: list[list[int]] = data_field(default_factory=lambda: [[]])
    made: dict[frozenset[int], dict[str, frozenset[int]]] = data_field(default_factory=dict)

    def __post_init__(self) -> None:
        at, stack, last = 0, [], 0
        self.mandatory = 0
        for m in [*_MARK.finditer(self.template.text), None]:
            for w in words(self.template.text[last : m.start() if m else None]):
                at = self._step(at, w)
                self.mandatory += not stack
            if m is None:
                break
            last = m.end()
            if m[1] == "beginOptional":
                stack.append(at)
            elif m[1] == "endOptional":
                self.free[stack.pop()].append(at)
            else:
                given = dict(x.split("=") for x in m[2].split(";") if "=" in x)
                few, many = int(given.get("min", 1)), int(given.get("max", 1))
                skips = []
                for k in range(many):
                    if k >= few:
                        skips.append(at)
                    at = self._step(at, ANY)
                for s in skips:
                    self.free[s].append(at)
        if stack:
            raise ValueError(f"an optional region of {self.template.label} does not end")
        self.accept, self.start = at, self._closed({0})
        if self.accept in self.start:
            raise ValueError(f"{self.template.label} has no mandatory words")

    def _step(self, at: int, word: str) -> int:
        self.steps.append([])
        self.free.append([])
        self.steps[at].append((word, len(self.steps) - 1))
        return len(self.steps) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def after(self, states: frozenset[int], word: str) -> frozenset[int]:
        row = self.made.setdefault(states, {})
        known = word if any(w == word for s in states for w, _ in self.steps[s]) else ANY
        if known not in row:
            row[known] = self._closed({n for s in states for w, n in self.steps[s] if w in (known, ANY)})
        return row[known]

    def openings(self) -> set[tuple[str, ...]]:
        """The one or two words with which a match may begin (one where a region of any words or the end follows)."""
        out: set[tuple[str, ...]] = set()
        for w, n in ((w, n) for s in self.start for w, n in self.steps[s]):
            then = self._closed({n})
            nexts = {v for s in then for v, _ in self.steps[s]}
            if w == ANY:
                raise ValueError(f"{self.template.label} must begin with a word")
            out |= {(w,)} if ANY in nexts or self.accept in then else {(w, v) for v in nexts}
        return out

    def match(self, text: _words.Words, at: int, end: int) -> int:
        """End of the longest accepted stretch from word ``at``, or -1."""
        states, best = self.start, -1
        for k in range(at, end):
            states = self.after(states, text.word(k).decode("utf-8", "replace"))
            if not states:
                break
            if self.accept in states:
                best = k + 1
        return best


class Scanner:
    """All templates together: openings by hash, then the automata."""

    def __init__(self, templates: Iterable[Template]) -> None:
        self.automata = [Automaton(t) for t in templates]
        self.by_opening: dict[int, list[Automaton]] = {}
        self.lengths: dict[int, np.ndarray] = {}
        keys: dict[int, set[int]] = {}
        for a in self.automata:
            for opening in a.openings():
                raw = " ".join(opening).encode()
                w = _words.split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                key = int(_words.windows(w.hashes(), len(opening))[0])
                self.by_opening.setdefault(key, []).append(a)
                keys.setdefault(len(opening), set()).add(key)
        self.lengths = {n: np.array(sorted(k), np.uint64) for n, k in keys.items()}

    def places(self, text: _words.Words) -> list[tuple[int, int, int, Automaton]]:
        """(document, first word, end word, automaton) of every match; words are counted over all documents."""
        hashes = text.hashes()
        found = []
        for n, keys in self.lengths.items():
            h = _words.windows(hashes, n)
            slot = np.zeros(1 << 16, bool)
            slot[(keys >> np.uint64(48)).astype(np.int64)] = True
            maybe = np.flatnonzero(slot[(h >> np.uint64(48)).astype(np.int64)])
            for i in maybe[np.isin(h[maybe], keys)].tolist():
                doc = int(np.searchsorted(text.first, i, side="right")) - 1
                for a in self.by_opening[int(h[i])]:
                    if (e := a.match(text, i, int(text.first[doc + 1]))) >= 0:
                        found.append((doc, i, e, a))
        return found


def scan_licenses(
    docs: DataFrame, templates: Iterable[Template] = BASE + NOTICES + TEXTS, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False
) -> DataFrame:
    """One row per row of ``docs``: what license wording its whole text holds.

    Columns: id, ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and ``last_word`` (their smallest and
    largest start, words from 0; else null), ``base_labels`` and ``labels`` (distinct, sorted, comma-joined; empty
    without matches), ``score`` (0 without a match, else ``m / (m + 2)`` for the match with most mandatory words ``m``)
    and, with ``with_spans``, ``spans`` (``label:first word:end word``, comma-joined in order of place).

    Null and empty texts have no words; null ids stay null; repeated rows are scanned each; texts of any length are
    scanned whole; of matches from one word the longest counts; an empty table gives an empty result; other columns are
    not read.
    """
    templates = tuple(templates)
    out = [field(docs, id_col), long("n_words"), long("n_base"), long("first_word"), long("last_word"), string("base_labels"), string("labels"), double("score")]
    if with_spans:
        out.append(string("spans"))

    def each(batch: pa.RecordBatch):
        scanner = scanner_of(templates)
        for a, b, text in _words.batch_words(batch, text_col):
            n = b - a
            per_doc: list[list] = [[] for _ in range(n)]
            for doc, i, e, auto in scanner.places(text):
                per_doc[doc].append((i - int(text.first[doc]), e - int(text.first[doc]), auto))
            base = [[s for s, _, x in p if x.template.base] for p in per_doc]
            best = [max((x.mandatory for _, _, x in p), default=0) for p in per_doc]
            cols = {
                id_col: batch.column(0).slice(a, n),
                "n_words": text.counts,
                "n_base": [len(s) for s in base],
                "first_word": [min(s, default=None) for s in base],
                "last_word": [max(s, default=None) for s in base],
                "base_labels": [",".join(sorted({x.template.label for _, _, x in p if x.template.base})) for p in per_doc],
                "labels": [",".join(sorted({x.template.label for _, _, x in p})) for p in per_doc],
                "score": [m / (m + 2) for m in best],
            }
            if with_spans:
                cols["spans"] = [",".join(f"{x.template.label}:{s}:{e}" for s, e, x in sorted(p, key=lambda y: (y[0], y[1], y[2].template.label))) for p in per_doc]
            yield cols

    return map_batches(docs.select(id_col, text_col), out, each)


_SCANNERS: dict[tuple[Template, ...], Scanner] = {}


def scanner_of(templates: tuple[Template, ...]) -> Scanner:
    if templates not in _SCANNERS:
        _SCANNERS[templates] = Scanner(templates)
    return _SCANNERS[templates]
