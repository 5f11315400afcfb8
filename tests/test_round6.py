"""Searches whose work grew faster than their tables."""

from __future__ import annotations

import math
import random
import re
import threading
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import search, textindex
from docloom.plans import catalogue, retrieval


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def plain_matches(chunks, asked):
    words = lambda x: [w for w in re.findall(r"[^\W_]+", (x or "").lower()) if w not in search.STOP]
    out = []
    for q, text in asked:
        need = set(words(text))
        for c, body in chunks:
            own = words(body)
            if need and need <= set(own):
                out.append((q, c, round(sum(w in need for w in own) / (1 + math.log(len(own))), 9)))
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_of_texts_meet_groups_of_queries(spark, monkeypatch, kind):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["red", "Blue", "w1", "w2", "w3", "the", "déjà", "٣", "x_y"]) for _ in range(n))
    chunks = [(str(k) if kind == "string" else k, text(rng.randrange(1, 9))) for k in range(300)] + [(None, "red blue"), (None, "w1"), ("7" if kind == "string" else 7, "red red"), ("400" if kind == "string" else 400, None), (None, ""), (None, " - ")]
    asked = [(k, text(rng.randrange(1, 4))) for k in range(60)] + [(60, "red"), (61, "red"), (62, "the"), (63, None), (64, "red absent"), (None, "w1 W1"), (65, "")]
    a, b = spark.createDataFrame(chunks, f"chunk_id {kind}, chunk_text string"), spark.createDataFrame(asked, "query_id long, query string")
    want = plain_matches(chunks, asked)
    for name, n in (("FEW", 1), ("TEXTS", 90), ("ASKED", 20), ("LEAST", 100)):
        monkeypatch.setattr(search, name, n)
    rows = lambda df: Counter((r[0], r[1], round(r[2], 9)) for r in df.collect())
    assert rows(search.text_matches(a, b)) == Counter(want)
    got = rows(search.text_hits(a, b, 3))
    for q in {r[0] for r in want}:
        scores = sorted((r[2] for r in want if r[0] == q), reverse=True)[:3]
        assert sorted((r[2] for r in got.elements() if r[0] == q), reverse=True) == scores
        if kind == "long" and q is not None:
            order = lambda r: (-r[2], -1 if r[1] is None else r[1])  # noqa: E731  (null first)
            assert sorted((r for r in got.elements() if r[0] == q), key=order) == sorted((r for r in want if r[0] == q), key=order)[:3]


def test_texts_alike_are_cut_by_their_ids(monkeypatch):
    texts = pa.array(["red"] * 50 + ["red red x"] * 50 + ["blue"])
    ids = np.random.default_rng(1).permutation(101)
    monkeypatch.setattr(search, "TOGETHER", 60)  # several stripes
    for k, many in ((None, 100), (4, 4)):
        q, r, tf, n = search.held_together(texts, pa.array(["red", "blue red", "red", "blue", "none"]), pa.array(ids), k)
        assert Counter(q.tolist()) == {0: many, 2: many, 3: 1}
        best = [(tf[i] / (1 + math.log(n[i])), ids[r[i]]) for i in np.flatnonzero(q == 2)]
        if k:
            assert sorted(i for s, i in best if s == 1.0) == sorted(ids[:50])[:4]
    assert all(len(x) == 0 for x in search.held_together(pa.array(["", "a"]), pa.array([], pa.string()), pa.array([1, 2]), 3))


def test_common_words_make_no_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "FEW", 1)
    common = " ".join(f"common{i}" for i in range(300))
    docs = spark.range(20000).select(F.col("id").alias("chunk_id"), F.concat(F.lit(common + " own"), F.col("id")).alias("chunk_text")).repartition(4)
    asked = spark.range(3000).select(F.col("id").alias("query_id"), F.concat(F.lit("common"), F.col("id") % 300, F.lit(" common"), F.floor(F.col("id") / 300)).alias("query"))
    spark.sparkContext.setJobGroup("pairs", "pairs", True)
    stop = threading.Timer(60, lambda: spark.sparkContext.cancelJobGroup("pairs"))  # 60,000,000 pairs, each with the text's words
    stop.start()
    try:
        got = search.text_hits(docs, asked, 2).groupBy("chunk_id").count().collect()
    finally:
        stop.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == [(0, 3000), (1, 3000)]


def test_similar_documents_reads_its_hits_again_not_the_texts(spark, sf_small):
    made = plan(catalogue.queries()["similar_documents"](spark, sf_small))
    assert "regexp" not in made and "FlatMapCoGroups" not in made and "MapInArrow" not in made


def bm25_rows(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], round(r["score"], 7)))
    return {q: sorted(x) for q, x in out.items()}


def test_bm25_by_a_scan_is_that_of_an_index(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["alpha", "Beta", "le", "the", "rare", *[f"w{i}" for i in range(30)]]) for _ in range(n))
    rows = [(k, text(rng.randrange(0, 40)), rng.choice(["en", "fr", "xx", None])) for k in range(400)] + [(k, None, "en") for k in range(400, 420)] + [(k, "alpha - copied", "en") for k in range(420, 470)] + [(470, "", "en"), (471, " -- ", None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, chunk_text string, language string")
    asked = spark.createDataFrame([(k, text(rng.randrange(1, 9))) for k in range(30)] + [(30, "copied"), (31, "the"), (32, None), (33, ""), (34, "nowhere"), (35, "copied copied nowhere"), (None, "alpha")], "query_id long, query string")
    monkeypatch.setattr(textindex, "BYTES", 3000)
    index = textindex.build(chunks, f"file://{tmp_path}/i", block=50, buckets=4)
    for language in (None, F.lit("fr")):
        want = bm25_rows(textindex.bm25(index, asked, 5, language).collect())
        assert want and bm25_rows(textindex.bm25_scan(chunks, asked, 5, language).collect()) == want
        monkeypatch.setattr(textindex, "PAIRS", 9)  # many groups of queries, beyond those that are broadcast
        assert bm25_rows(textindex.bm25_scan(chunks, asked, 5, language, size=1).collect()) == want
        monkeypatch.undo()
    assert [c for _, c, _ in want[30]] == [420, 421, 422, 423, 424]
    for none in (chunks.limit(0), chunks.where("chunk_text is null")):
        assert textindex.bm25_scan(none, asked, 3).count() == 0
    assert textindex.bm25_scan(chunks, asked.limit(0), 3).count() == 0


def test_alike_scores_are_cut_by_their_ids():
    ids, score = pa.array([9, 4, 7, 1, 3]), np.array([1.0, 1.0, 1.0, 2.0, 1.0])
    assert sorted(ids.to_numpy()[textindex._first_alike(np.arange(5), score, ids, 2)].tolist()) == [1, 3, 4]


def test_bm25_alone_builds_no_index(spark, sf_small, monkeypatch):
    built, real = [], textindex.build
    monkeypatch.setattr(textindex, "build", lambda *a, **k: built.append(1) or real(*a, **k))
    monkeypatch.setattr(retrieval, "_index_place", lambda spark, sf, place=retrieval._index_place: f"{place(spark, sf)}-alone")
    alone = catalogue.queries()["bm25_topk"](spark, sf_small).collect()
    assert not built and alone
    retrieval.index(spark, sf_small)
    assert built and set(map(str, catalogue.queries()["bm25_topk"](spark, sf_small).collect())) == set(map(str, alone))


def test_a_block_looks_up_its_lengths_once():
    rows = pa.table({"chunks": pa.array([[5, 8], [8]]), "ends": pa.array([[1, 3], [1]], pa.list_(pa.int32())), "lengths": pa.array([[10, 20], [20]], pa.list_(pa.int32()))})
    held = textindex._Block(rows)
    assert held.of("lengths").tolist() == [10, 20] and held.of("lengths") is held.of("lengths")  # it was made anew for every query
