"""Plain re-statements of what the operators promise, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pyarrow.parquet as pq

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONSPACE = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = {c: c + 32 for c in range(65, 91)}


def rows(sf_dir: str, name: str) -> list[dict]:
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def words(text: str | None, pattern: re.Pattern = ALNUM) -> list[str]:
    return pattern.findall((text or "").translate(ASCII))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None, n: int) -> frozenset:
    w = words(text, NONSPACE)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(sets: dict[int, frozenset], percent: int = 80) -> dict[int, int]:
    """Smallest id reachable over links of similarity, by all pairs that share a shingle."""
    above = {k: k for k in sets}

    def find(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    holders = defaultdict(list)
    for k in sorted(sets):
        common = defaultdict(int)
        for s in sets[k]:
            for other in holders[s]:
                common[other] += 1
            holders[s].append(k)
        for other, both in common.items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[other]) - both):
                a, b = sorted((find(k), find(other)))
                above[b] = a
    return {k: find(k) for k in sets}


def contamination(text: str | None, items: list[tuple], n: int = 10) -> tuple[int, int, list[str]]:
    """(words, hit words, items) of a text against (id, text) items."""
    w = words(text)
    hit, found = set(), set()
    for key, item in items:
        x = words(item)
        size = min(n, len(x))
        windows = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if size else set()
        for i in range(len(w) - size + 1) if windows else ():
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(key))
    return len(w), len(hit), sorted(found)


def auc(pairs: list[tuple[float, int]]) -> float:
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
