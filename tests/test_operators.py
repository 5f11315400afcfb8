"""Single operators on small inputs with known results."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import scores, vectors
from docloom.functions import text
from docloom.operators import chunking, feedback, relations, tables
from docloom.plans import catalogue
from docloom.sources import files
from docloom.streaming import limits


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, -1.0, 0.0, 0.0, None]


def test_every_text_match_counts(spark, tmp_path):
    n = 1_000_001
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("Alpha, beta").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "beta alpha gamma"), (2, "gamma delta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in catalogue.queries()["text_match_all_terms"](spark, str(tmp_path)).collect()] == [(1, n)]


def test_pages_are_read_from_whole_texts(spark, tmp_path):
    raw = "--- Page 3 --- " + "word " * 50_000 + "see p. 12 or page 5"
    spark.createDataFrame([(2000, raw), (1, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["page_numbers"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["pages"] for r in got} == {2000: [3, 5, 7, 12], 1: [1, 7]}


def test_topics_are_whole_first_lines(spark, tmp_path):
    rows = [(1, "x " * 40 + "omega\nalpha", "a"), (2, "y " * 40 + "omega\nbeta", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalogue.queries()["jaccard_pairs"](spark, str(tmp_path)).collect()] == [("a", "b", 1, 0.333333)]


def test_feedback_confidence_and_priority(spark):
    one = spark.createDataFrame([("citation_accuracy", 4)], "category string, rating int")
    assert feedback.feedback_confidence(one).first()["confidence"] == pytest.approx(0.305)
    found = {r["category"]: r for r in feedback.category_priorities(one).collect()}
    assert found["citation_accuracy"]["weighted"] == 1.0 and found["citation_accuracy"]["priority"] == pytest.approx(0.0625)
    assert len(found) == 6 and found["usability"]["n"] == 0 and found["usability"]["priority"] is None
    assert feedback.feedback_confidence(one.limit(0)).first()["confidence"] == 0.0


def test_quality_weights_add_up():
    assert sum(scores.QUALITY_WEIGHTS.values()) == pytest.approx(1) and sum(scores.CITATION_WEIGHTS.values()) == pytest.approx(1)


def test_conflicts_before_complements(spark):
    pairs = spark.createDataFrame([(1, 2, 0.1, 0.8, 0.9), (1, 3, 0.1, 0.6, 0.9), (2, 3, 0.8, 0.0, 0.9), (2, 4, 0.5, 0.1, 0.7), (3, 4, 0.1, 0.1, 0.1)], "a int, b int, content double, topic double, structure double")
    assert {(r["a"], r["b"]): r["kind"] for r in relations.relationships(pairs).collect()} == {(1, 2): "conflicting", (1, 3): "complementary", (2, 3): "similar", (2, 4): "referential"}


def test_table_parsing_types_and_quality(spark):
    raw = "| id | price | on | what |\n| --- | --- | --- | --- |\n| 1 | USD five | 2024-01-05 | abc |\n| 2,000 | $5 |  | x |\nno table here"
    df = tables.parse(spark.createDataFrame([(1, raw), (2, "a | b"), (3, None)], "id int, text string"), "id", "text")
    row = df.select("id", "headers", "rows", tables.column_types(F.col("headers"), F.col("rows")).alias("types"), tables.quality(F.col("headers"), F.col("rows")).alias("quality")).collect()
    assert len(row) == 1 and row[0]["headers"] == ["id", "price", "on", "what"]
    assert row[0]["types"] == ["numerical", "numerical", "date", "text"] and row[0]["quality"] == pytest.approx(1 - 1 / 8)


def test_tables_end_at_blank_lines(spark):
    raw = "a | b\n1 | 2\n\nnot this one |\n \n| c |\n|---|\n|| 3 |\nwords\n| 4 |"
    df = tables.parse(spark.createDataFrame([(1, raw), (2, "")], "id int, text string"), "id", "text")
    assert [(r["table"], r["headers"], r["rows"]) for r in df.orderBy("table").collect()] == [(0, ["a", "b"], [["1", "2"]]), (1, ["c"], [["3"], ["4"]])]


def test_long_odd_texts_take_linear_time(spark):
    lines = "\n".join(f"line {i}" if i % 3 else f"{i}. start" for i in range(200_000))
    df = spark.createDataFrame([(1, lines), (2, "a" + " " * 1_000_000 + "b"), (3, None), (4, "")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["n"] for r in chunking.clauses(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 66_667, 2: 1} and time.time() - began < 60
    assert [r["n"] for r in df.select(F.length(text.strip(F.concat("text", F.lit(" \n")))).alias("n")).collect()] == [len(lines), 1_000_002, None, 0]


def packed(pieces, limit, joint):
    out, now, n = [], [], 0
    for p in pieces:
        m = len(p.split())
        if n + m <= limit:
            now, n = ([p] if n == 0 else [*now, p]), n + m
        else:
            out += [joint.join(now)] if n else []
            now, n = [p], m
    return out + ([joint.join(now)] if n else [])


def test_chunk_packing_equals_a_plain_loop(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    limit = 40
    got = {}
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows[:300]], "doc_id long, text string")
    for r in df.select("doc_id", F.posexplode(chunking.packed(F.split("text", "\n"), limit, "\n\n"))).collect():
        got.setdefault(r["doc_id"], []).append(r["col"])
    for r in rows[:300]:
        assert got.get(r["doc_id"], []) == packed(r["text"].split("\n"), limit, "\n\n"), r["doc_id"]
    tokens = df.select("doc_id", chunking.token_limited(F.col("text"), 50).alias("c")).collect()
    for r, x in zip(rows[:300], sorted(tokens, key=lambda y: [z["doc_id"] for z in rows].index(y["doc_id"])), strict=True):
        words = r["text"].split()
        if len(words) <= 50:
            assert x["c"] == [r["text"]]
        elif "\n\n" not in r["text"]:
            assert x["c"] == [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]


# Texts whose scores are published, with those scores.
SCORED_CHUNKS = [
    ("Machine learning has revolutionized many industries, particularly healthcare. According to recent studies, ML algorithms can achieve up to 95% accuracy in medical image analysis.", "Introduction", 0.327536231884058),
    ("Our results show that Neural Networks outperformed other algorithms with 94.7% accuracy on the test set. Random Forest achieved 92.1% and SVM achieved 89.3%.", "Results", 0.4547619047619048),
]
SCORED_CITATIONS = [
    ("According to recent studies, ML algorithms can achieve up to 95% accuracy in medical image analysis.", [2], "Introduction", 0.10833333333333334),
    ("Smith, J. et al. 'ML in Healthcare', Journal of Medical AI, 2023, pages 45-52.", [6], "References", 0.0),
]


def test_published_scores_of_chunks_and_citations(spark):
    chunks = spark.createDataFrame([(x, y) for x, y, _ in SCORED_CHUNKS], "c string, context string")
    m = scores.chunk_quality(F.col("c"), F.col("context"), F.lit("academic_paper"))
    assert [r[0] for r in chunks.select(scores.weighted(m, scores.QUALITY_WEIGHTS)).collect()] == pytest.approx([z for *_, z in SCORED_CHUNKS], abs=1e-12)
    cited = spark.createDataFrame([x[:3] for x in SCORED_CITATIONS], "c string, pages array<int>, title string")
    m = scores.citation(F.col("c"), F.lit("research_paper.pdf"), F.col("pages"), F.col("title"))
    assert [r[0] for r in cited.select(scores.weighted(m, scores.CITATION_WEIGHTS)).collect()] == pytest.approx([z for *_, z in SCORED_CITATIONS], abs=1e-12)


def test_slices_of_long_and_wide_tables(spark):
    df = spark.createDataFrame([(1, ["a"] * 3, [["x"] * 3] * 12), (2, list("abcdefghij"), [["x"] * 10] * 3), (3, ["a"], [["x"]])], "id int, headers array<string>, rows array<array<string>>")
    got = sorted((r["id"], r["strategy"], r["first"], r["last"]) for r in tables.slices(df, "id").collect())
    assert got == [(1, "horizontal", 0, 9), (1, "horizontal", 10, 11), (2, "vertical", 0, 3), (2, "vertical", 4, 7), (2, "vertical", 8, 9), (3, "complete", 0, 0)]


def test_streams_give_the_batch_results(spark, sf_small, tmp_path):
    events = spark.read.parquet(f"{sf_small}/events.parquet").select(F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("client"), "user_id", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(spark.table(name).collect())

    assert run(limits.window_counts(stream, 3600, 2, "40 days"), "complete", "hourly") == sorted(limits.window_counts(events, 3600, 2).collect())
    typed = lambda df: df.select(F.when(F.col("event_id") % 2 == 0, "text").otherwise("hybrid").alias("search_type"), F.col("value").alias("response_time_ms"), (F.col("event_id") % 3).alias("result_count"))
    batch = sorted(limits.running_counters(typed(events)).withColumn("mean_ms", F.round("mean_ms", 6)).collect())
    assert run(limits.running_counters(typed(stream)).withColumn("mean_ms", F.round("mean_ms", 6)), "complete", "counters") == batch
    assert run(limits.slow_searches(typed(stream), F.col("response_time_ms") / 100), "append", "slow") == sorted(limits.slow_searches(typed(events), F.col("response_time_ms") / 100).collect())


def test_folders_of_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes("# T\r\né".encode())
    (tmp_path / "in" / "b.exe").write_text("x")
    (tmp_path / "c.txt").write_text("")
    got = {r["filename"]: (r["mime_type"], r["file_size"], r["content"]) for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("text/markdown", 7, "# T\né")}


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
