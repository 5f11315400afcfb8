"""The stored text index against plain searches."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import search, textindex

VOCABULARY = ["the", "of", "le", "de", "alpha", "beta", "gamma", "delta", "é2", "zeta", *(f"w{k}" for k in range(60))]


def corpus(n=300, seed=5):
    rnd = random.Random(seed)
    weights = [40 / (k + 1) for k in range(len(VOCABULARY))]
    out = [(k, k // 3, " ".join(rnd.choices(VOCABULARY, weights, k=rnd.randint(0, 60))).title() + rnd.choice(["", ".", "?!"]), ("en", "fr", "de", None)[k % 4]) for k in range(n)]
    return out + [(n, n, None, "en"), (n + 1, n, "rare rare w1", "en"), (n + 2, n, "alpha beta " * 50, "en")]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(corpus(), "chunk_id long, document_id long, chunk_text string, language string")
    return textindex.build(df, f"file://{tmp_path_factory.mktemp('index')}/x", block=16, buckets=8)


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def test_phrases(spark, index):
    queries = ["alpha beta", "alpha of beta", "beta beta", "the of", "alpha the w1", "nowhere", "é2 gamma", ""]
    want = {}
    for q, text in enumerate(queries):
        own = [(k, w) for k, w in enumerate(words(text)) if w not in search.STOP]
        for c, _, body, _ in corpus():
            w = words(body)
            starts = [s for s in range(-len(own), len(w)) if own and all(0 <= s + k < len(w) and w[s + k] == x for k, x in own)]
            if starts:
                want[q, c] = (len(starts), starts[0])
    got = {(r["query_id"], r["chunk_id"]): (r["hits"], r["first"]) for r in textindex.phrase_search(index, asked(spark, *queries)).collect()}
    assert got == want and {q for q, _ in want} >= {0, 1, 2}


@pytest.mark.parametrize("distance", [1, 4, 30])
def test_nearness(spark, index, distance):
    queries = ["alpha gamma", "w3 alpha beta", "beta", "alpha missing"]
    want = {}
    for q, text in enumerate(queries):
        own = set(words(text))
        for c, _, body, _ in corpus():
            w = words(body)
            spans = [b - a for a in range(len(w)) for b in range(a, min(len(w), a + distance + 1)) if own <= set(w[a : b + 1])]
            if spans:
                want[q, c] = min(spans)
    assert {(r["query_id"], r["chunk_id"]): r["span"] for r in textindex.near_search(index, asked(spark, *queries), distance).collect()} == want


def full_bm25(text, language="en"):
    stop = {"en": search.STOP, "fr": textindex.FRENCH}
    bodies = {c: (words(b), lang) for c, _, b, lang in corpus()}
    length = {c: sum(x not in stop.get(lang, ()) for x in w) for c, (w, lang) in bodies.items()}
    mean = sum(length.values()) / len(length)
    score = {}
    for term in {t for t in words(text) if t not in stop.get(language, ())}:
        df = sum(term in w for w, _ in bodies.values())
        for c, (w, _) in bodies.items():
            if tf := w.count(term):
                score[c] = score.get(c, 0) + math.log(1 + (len(bodies) - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * length[c] / mean))
    return sorted(((round(s, 9), c) for c, s in score.items()), key=lambda x: (-x[0], x[1]))


def test_bm25_skips_blocks_and_stays_exact(spark, index):
    queries = ["rare w1", "alpha beta rare", "w40 w41", "alpha beta gamma delta", "nowhere", "the"]
    told = {}
    got = {}
    for r in textindex.bm25(index, asked(spark, *queries), 3, told=told).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["chunk_id"])
    for q, text in enumerate(queries):
        best = full_bm25(text)[:3]
        mine = [got.get(q, {})[k + 1] for k in range(len(best))]
        assert [c for _, c in mine] == [c for _, c in best] and all(abs(a - b) < 1e-8 for (a, _), (b, _) in zip(mine, best, strict=True))
    assert 0 < told["read"] < told["pairs"]  # some blocks were never read


def test_languages_drop_their_own_words(spark, index):
    french = textindex.bm25(index, asked(spark, "le the"), 400, language=F.lit("fr")).collect()
    assert {r["chunk_id"] for r in french} == {c for c, _, b, _ in corpus() if "the" in words(b)}
    unknown = textindex.bm25(index, asked(spark, "le the"), 400, language=F.lit("xx")).collect()
    assert {r["chunk_id"] for r in unknown} == {c for c, _, b, _ in corpus() if {"the", "le"} & set(words(b))}


def test_matches_are_those_of_a_scan(spark, index):
    df = spark.createDataFrame([(c, b) for c, _, b, _ in corpus()], "chunk_id long, chunk_text string")
    q = asked(spark, "alpha beta", "the w3 w3", "gamma", "nowhere at all")
    a, b = ({(r[0], r[1]): round(r[2], 9) for r in x.collect()} for x in (textindex.text_matches(index, q), search.text_matches(df, q)))
    assert a == b and a


def test_only_asked_folders_are_read_and_built_once(spark, index):
    q = asked(spark, "w7")
    rows = index.postings(textindex.asked_terms(q))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S)[1]
    own = q.select(textindex.bucket(F.lit("w7"), 8)).first()[0]
    assert "bucket" in filters and str(own) in filters
    assert {r["term"] for r in rows.collect()} == {"w7"}
    again = textindex.build(spark.createDataFrame([], "chunk_id long, document_id long, chunk_text string, language string"), index.path)
    assert again.facts == index.facts  # opened, not built again


def test_an_empty_index(spark, tmp_path):
    none = textindex.build(spark.createDataFrame([], "chunk_id long, document_id long, chunk_text string, language string"), f"file://{tmp_path}/e")
    assert none.facts["chunks"] == 0
    q = asked(spark, "alpha")
    assert textindex.bm25(none, q, 3).count() == 0 and textindex.phrase_search(none, q).count() == 0
