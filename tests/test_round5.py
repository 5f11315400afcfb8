"""Faults that were expected on larger tables, on small inputs."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from docloom.functions import scores
from docloom.functions import text as t
from docloom.operators import chunking, layout, search, tablestore
from docloom.plans import catalogue, retrieval, stores


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strategies_are_compared_in_one_pass(spark, tmp_path):
    head, other = "# One Heading", "INTRODUCTION AND SCOPE"
    rows = [
        (1, f"before\n{head}\na b c\n{head}\n d e \n\n{other}\nSECTION 1. x\nStep 2: y z\n3. w"), (2, None), (3, ""), (4, " \n\t\n"), (5, "long " * 2500 + "\nshort"), (6, f"{head}\n{head}"), (7, "one line"), (8, f"{other}\n\n{other}\nb\n\x0bc\r\n{head}"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    for separator in ("\n", "\n\n"):
        cut = chunking.by_strategy(docs, separator=separator).select("doc_id", "strategy", t.token_count(F.col("chunk_text")).alias("word_count"), "boundary")
        made = chunking.word_counts(docs, separator=separator)
        assert Counter(map(tuple, cut.collect())) == Counter(map(tuple, made.collect()))
    assert plan(chunking.compare(docs)).count("Relation [") == 1  # it was fifteen scans and as many cuts


def _words(spark, folder):
    """Three documents of several windows and one query for each of two items."""
    docs = [(k, " ".join(f"w{(k * 37 + i) % 90} common" for i in range(150)), "en", "s", 9) for k in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, "w5 common and more"), (1, "absent common"), (2, "the of")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_a_search_alone_builds_no_index(spark, tmp_path, monkeypatch):
    sf, built = _words(spark, tmp_path), []
    real = retrieval.textindex.build
    monkeypatch.setattr(retrieval.textindex, "build", lambda *a, **k: built.append(1) or real(*a, **k))
    names = ("acl_search", "context_assembly", "text_rank_topk", "text_match_all_terms", "batch_benchmark_search")
    rows = lambda n: Counter(map(str, catalogue.queries()[n](spark, sf).collect()))
    alone = [rows(n) for n in names]
    assert not built and all(alone)
    retrieval.index(spark, sf)
    assert built and [rows(n) for n in names] == alone  # the same from the index


def test_few_lexemes_go_on_alone(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, f"red w{k % 3} red the blue" + " x" * k) for k in range(9)] + [(9, None), (10, "")], "chunk_id long, chunk_text string")
    asked = spark.createDataFrame([(0, "red w1"), (1, "blue red blue"), (2, "red absent"), (3, "the"), (4, None)], "query_id long, query string")
    few = Counter(map(tuple, search.text_matches(chunks, asked).collect()))
    monkeypatch.setattr(search, "FEW", 1)
    assert few == Counter(map(tuple, search.text_matches(chunks, asked).collect())) and len(few) == 12


def test_boxes_of_a_task_are_bounded(spark):
    sides = [F.col("id") % 4 * 60.0 + 0.5, F.floor(F.col("id") % 9 / 3) * 14.0 + F.col("id") % 2 * 3, F.col("id") % 4 * 60.0 + 50, F.floor(F.col("id") % 9 / 3) * 14.0 + 9]
    boxes = spark.range(6000).select((F.col("id") % 700).alias("page"), "id", *[x.alias(n) for x, n in zip(sides, ("x0", "y0", "x1", "y1"), strict=True)])
    rows = lambda df: Counter(map(str, df.collect()))
    dealt = layout.box_groups(boxes, in_task=100)
    assert dealt.rdd.getNumPartitions() == 60 and rows(dealt) == rows(layout.box_groups(boxes))
    assert dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Sort [") == 2  # it was three: each holds a task's boxes


def test_buckets_are_no_tasks(spark, tmp_path):
    table = tablestore.KeyedTable(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], 2)
    rows = spark.range(4000).select(F.col("id").alias("k"), F.concat(*[F.sha2((F.col("id") * 9 + i).cast("string"), 256) for i in range(8)]).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        for add in (0, 2000):
            table.merge(rows.select((F.col("k") + add).alias("k"), "v"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert all(len(list((tmp_path / "t" / f).glob("part-*.parquet"))) > 1 for f in table.folders().values())  # it was one each
    want = rows.select((F.col("k") + 2000).alias("k"), "v").union(rows.where("k < 2000"))
    assert table.read().count() == 6000 and table.read().exceptAll(want).count() == 0


def test_ingested_files_grow_in_number(spark, tmp_path, monkeypatch):
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    made, real = [], stores.Scratch
    monkeypatch.setattr(stores, "Scratch", lambda *a: made.append(real(*a)) or made[-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = catalogue.queries()["ingested_documents"](spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    files, batches = (sum(n.startswith(x) or n.endswith(x) for n in made[0].names(f)) for f, x in (("in", "part-"), ("table/manifests", ".json")))
    assert got.count() == 900 and files >= 9 and batches == 2  # it was four files, whatever their size


def test_quality_metrics_share_one_list_of_words(spark, tmp_path):
    c, low, az = F.col("c"), F.lower("c"), scores.az_words(F.lower("c"))
    rows = [(x,) for x in ("The plain words of it.", "Kelvin measured İstanbul.", "", "1 2 3", "café x_y the of")]
    df = spark.createDataFrame(rows, "c string")
    got = [tuple(r) for r in df.select(F.round(scores.content_density(az), 6), F.round(scores.readability(c, az), 6), scores.context_preservation(low, F.lit("plain words here"), az)).collect()]
    assert got == [(0.32, 0.6, 0.6), (0.6, 0.5, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.3, 0.0)], got
    spark.createDataFrame([(1, "some text here", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    made = plan(catalogue.queries()["quality_metric_means"](spark, str(tmp_path)))
    assert made.count("_])[a-z]++") == 1 and "[a-z]{3,}+" not in made  # the text was matched anew for every metric
