"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from docloom.llm import _training, chat, decontaminate, licenses, neardup, packing, quality, tokencount, topk, toxicity, urlfilter
from docloom.llm._spark import Workspace
from tests.llm import brute

LONG = "alpha beta gamma delta " * 30_000
ROWS = [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (4, "one", None), (4, "one", None), (None, "one two three", "y"), (5, LONG, "y"), (6, LONG + "omega", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows; extra columns bear names that the operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, id string")
    return df.withColumn("key", F.lit("k")).withColumn("score", F.lit(0.1)).withColumn("rank", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("component_id", F.lit(0))


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_topk(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [-1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>").withColumn("id", F.lit(0)).withColumn("v", F.lit(0))
    got = [tuple(r) for r in topk.top_k(v, v, k=5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 65536), (1, 2, 6, -65536), (2, 1, 1, 65536), (2, 2, 6, -65536), (6, 1, 1, -65536), (6, 2, 2, -65536)]
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0


def test_topk_over_many_shards(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 2]) for i in range(900)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(v, v.where("vec_id % 50 = 0"), k=5, shard_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    m = np.array([np.floor(256 * np.array(x)) for _, x in rows]).astype(int)
    for q, best in got.items():
        s = m @ m[q]
        assert best == [(i, -t) for t, i in sorted((-int(s[i]), i) for i in range(900) if i != q)[:5]]
    assert len(got) == 18


def test_chat_escapes_and_trees(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "<\\|turn|>", "<<s><<SYS>>[[INST]", None, "", "é\u2028𝄞"]
    rows = [(1, t, "assistant" if t % 2 else "user\\n\n<|end|>", x) for t, x in enumerate(texts)] + [(None, 0, None, "a"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1)).withColumn("node", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_conversations(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, x or "") for _, _, r, x in rows[: len(texts)]]
    assert got[1]["loss"] == [x or "" for _, t, _, x in rows[: len(texts)] if t % 2] and got[2]["loss"] == ["b", "b"] and len(got[None]["turns"]) == 1
    assert chat.format_conversations(df.limit(0)).count() == 0
    tree = [("t", 1, None, "user", "a", 0.0), ("t", 2, 1, "assistant", "b", 5.0), ("t", 3, 1, "assistant", "c", 1.0), ("t", 4, 3, "user", "d", 9.0), ("t", 5, 2, "user", "e", None)]
    paths = chat.format_trees(spark.createDataFrame(tree, "tree_id string, message_id long, parent_id long, role string, text string, score double"), best=None).orderBy("rank").collect()
    assert [(p["leaf_id"], p["formatted"].count("<|turn|>")) for p in paths] == [(4, 3), (5, 3)]


def test_chat_circle(spark):
    df = spark.createDataFrame([("t", 1, 2, 0.0), ("t", 2, 1, 0.0)], "tree string, node long, parent long, score double")
    with pytest.raises(ValueError, match="circle"):
        chat.reply_paths(df, Workspace(spark, "test"))


def test_urls(spark):
    rules = [urlfilter.Rule("a.com", "/x", "block"), urlfilter.Rule("A.com", "/x", "allow"), urlfilter.Rule("com", "/", "allow")]
    df = spark.createDataFrame([(1, "http://B.a.com/xy?q#f"), (2, "http://xa.com/x"), (3, None), (4, "a.com/x"), (None, "h://"), (5, "s://com")], "page_id long, url string").withColumn("host", F.lit("h")).withColumn("rule", F.lit("r"))
    expect = {1: ("b.a.com", "/xy", "a.com/x", "block"), 2: ("xa.com", "/x", "com/", "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), None: ("", "", None, "allow"), 5: ("com", "", None, "allow")}
    assert {r["page_id"]: tuple(r)[1:] for r in urlfilter.filter_urls(df, rules).collect()} == expect
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    assert {r["page_id"]: tuple(r)[1:] for r in urlfilter.filter_urls(df, table, max_rules=1).collect()} == expect
    assert urlfilter.filter_urls(df.limit(0), rules).count() == 0


def test_licenses(spark, docs, nothing):
    assert licenses.scan_licenses(docs).count() == len(ROWS) and licenses.scan_licenses(nothing).count() == 0
    df = spark.createDataFrame([(1, "Released under the terms of the MIT license. All rights reserved; ALL RIGHTS RESERVED"), (2, "under MIT license terms")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df, with_spans=True).collect()}
    assert (got[1]["labels"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == ("mit,reserved", 2, 8, 11) and got[2]["labels"] == "" and got[2]["score"] == 0


def test_whole_license_texts_and_one_wrong_word(spark):
    def filled(template):
        text = re.sub(r"<<beginOptional>>|<<endOptional>>", " ", template.text)
        return licenses.words(re.sub(r"<<var;[^>]*min=(\d+);[^>]*>>", lambda m: " someone" * int(m[1]), text))

    rows, expect = [], {}
    for k, template in enumerate(licenses.TEXTS):
        whole = filled(template)
        wrong = list(whole)
        wrong[max(i for i, w in enumerate(whole) if w != "someone")] = "otherwise1"
        rows += [(2 * k, ", ".join(whole).upper()), (2 * k + 1, " ".join(wrong))]
        expect[2 * k], expect[2 * k + 1] = template.label, None
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in expect.items():
        assert (label or licenses.TEXTS[k // 2].label) in got[k] if label else licenses.TEXTS[k // 2].label not in got[k], (k, label, got[k])


def test_nested_and_unbalanced_regions(spark):
    nested = licenses.Template("n", "alpha <<beginOptional>>beta <<beginOptional>>gamma<<endOptional>> delta<<endOptional>> omega")
    df = spark.createDataFrame([(k, x) for k, x in enumerate(["alpha omega", "alpha beta delta omega", "alpha beta gamma delta omega", "alpha gamma omega", "alpha beta omega"])], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df, [nested]).collect()} == {0: "n", 1: "n", 2: "n", 3: "", 4: ""}
    with pytest.raises(ValueError, match="does not end"):
        licenses.Automaton(licenses.Template("x", "a <<beginOptional>>b"))
    with pytest.raises(ValueError, match="no mandatory"):
        licenses.Automaton(licenses.Template("x", "<<beginOptional>>b<<endOptional>>"))


def test_urls_odd_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/é/x"), (2, "http://a.com/\ufffd"), (3, "http://a.com/" + "y" * 500_000)], "page_id long, url string")
    assert {r["verdict"] for r in urlfilter.filter_urls(df, []).collect()} == {"allow"} and {r["verdict"] for r in urlfilter.filter_urls(df, [], default="block").collect()} == {"block"}
    table = spark.createDataFrame([("a.com", "/\ufffd", "block"), (None, None, None), ("a.com", "/" + "y" * 1000, None)], "host string, path string, verdict string")
    for most in (urlfilter.MAX_RULES, 1):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.filter_urls(df, table, max_rules=most).collect()}
        assert got == {1: (None, "allow"), 2: ("a.com/\ufffd", "block"), 3: ("a.com/" + "y" * 1000, "block")}, most
    assert urlfilter.filter_urls(df, table, max_bytes=1).where("verdict = 'block'").count() == 2


def test_colliding_keys_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda s: 7)
    (tmp_path / "d").write_bytes(urlfilter.array_bytes([("a.com", "/", "block"), ("b.com", "/", "allow")]))
    array = urlfilter.DigestArray(str(tmp_path / "d"))
    found = array.find([(b"a.com/", 5), (b"b.com/", 5), (b"c.com/", 5), (b"b.com/", 4)])
    assert [bool(array.block[k]) if k >= 0 else None for k in found] == [True, False, None, None]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from docloom.llm._spark import shared_dir

    conf = SimpleNamespace(get=lambda k, d: d)
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


def test_topk_of_large_numbers_and_chunks(spark):
    """Scores beyond 2 ** 52, several chunks and shards, equal vectors in one cell."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 19), 1 << 19, 4)]) for i in range(300)] + [(i, [1.0, 2.0, 3.0, float(1 << 19)]) for i in range(300, 500)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(v, v.where("vec_id % 10 = 0"), k=5, shard_rows=50, chunk=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = {i: [int(256 * y) for y in x] for i, x in rows}
    for q, best in got.items():
        assert best == [(i, -t) for t, i in sorted((-sum(a * b for a, b in zip(x, whole[q], strict=True)), i) for i, x in whole.items() if i != q)[:5]]
    assert len(got) == 50
    with pytest.raises(Exception, match="differ in length"):
        topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), v).count()


def test_near_duplicates(spark, docs, nothing):
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, n=5).collect()), key=str)
    assert [(i, c, k) for i, _, c, k in got] == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (4, 3, False), (None, None, True), (5, 5, True), (6, 5, False)], key=lambda x: str((x[0],)))
    assert neardup.near_duplicates(nothing).count() == 0
    assert {r["_row"] for r in neardup.keep(docs).collect()} == {2}
    assert sorted(str(r["doc_id"]) for r in neardup.keep(docs).collect()) == ["1", "2", "3", "5", "None"] and neardup.keep(docs).columns == docs.columns


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    rows = [(7, "a b c d e f g h"), (7, "q r s t u v w x"), (7, "q r s t u v w x"), (3, "a b c d e f g h"), (-9, "unlike any other text here now"), (None, "a b c d e f g h")]
    got = sorted(((r["doc_id"], r["text"][:3]) for r in neardup.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, "q r"), (3, "a b"), (-9, "unl"), (None, "a b")], key=str)


def test_pages_of_one_template_meet_at_rare_shingles_only(spark, monkeypatch):
    """Groups that share most of their wording; the parts of one's own decide, with links inside and between groups."""
    rng = random.Random(4)
    shared = [f"t{i}" for i in range(121)]
    rows = []
    for k in range(150):
        own = [f"w{k}-{j}" for j in range(rng.choice((13, 14, 15, 16, 17, 20, 25)))]
        rows.append(shared + own)
    for k in range(60):  # some links through other words in common
        base = list(rows[rng.randrange(150)])
        for j in rng.sample(range(len(base)), rng.randrange(1, 7)):
            base[j] = f"x{k}-{j}"
        rows.append(base)
    rows = [" ".join(r) for r in rows]
    for n, light in ((2, 64), (2, 3)):
        monkeypatch.setattr(neardup, "LIGHT", light)
        expect = brute.components({i: brute.shingles(x, n) for i, x in enumerate(rows)})
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), n=n).collect()}
        assert got == expect and len(set(got.values())) > 1, light


def test_prefixes_hold_the_first_common_shingle():
    rng = np.random.default_rng(6)
    for percent in (50, 80, 95):
        for _ in range(300):
            x, y = (int(v) for v in rng.integers(1, 400, 2))
            least = -(-percent * (x + y) // (100 + percent))
            if least > min(x, y):
                continue
            mine = {(a, b): n for a, b, n in neardup.prefixes(x, percent)}
            own, other = (int(k) for k in neardup.size_class(np.array([x, y])))
            assert mine[own, other] >= x - least + 1, (x, y, percent)


def test_decontamination(spark, docs, nothing):
    items = [(1, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma"), (2, "One!"), (None, "two"), (3, None), (4, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[0] is not None]
    expect = sorted(((i, *brute.contamination(t, known)[:2], brute.sha(",".join(brute.contamination(t, known)[2]))) for i, t, _ in ROWS), key=str)
    for most in (decontaminate.MAX_WINDOWS, 1):
        got = decontaminate.decontaminate(docs, bench, max_windows=most)
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in got.collect()), key=str) == expect
        kept = decontaminate.keep(docs, bench, max_windows=most)
        assert sorted((str(r["doc_id"]), r["_row"]) for r in kept.collect()) == [("1", 2), ("2", 2)] and kept.columns == docs.columns
    assert decontaminate.decontaminate(nothing, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    clean = decontaminate.decontaminate(spark.createDataFrame([(1, "é, keep one this One.")], "doc_id long, text string"), bench, with_clean_text=True).first()["clean_text"]
    assert clean.replace(" ", "") == "é,keepthis."


def test_classifiers(spark, docs, nothing):
    labels = spark.createDataFrame([(3, 1, 1), (4, None, 0), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(docs, labels, label)
        scored = module.score(docs, model).collect()
        assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
        assert module.score(nothing, model).count() == 0 and module.keep(docs, model, 0.5).columns == docs.columns
        assert module.score(docs, module.fit(nothing, labels.limit(0), label)).first()["score"] == 0.5


def test_toxicity_scores_equal_a_plain_scorer():
    rng = np.random.default_rng(3)
    values, bias = rng.normal(size=1 << toxicity.BITS), -0.3
    texts = ["", "one", "Alpha beta, GAMMA alpha delta-beta é!", "x " * 50 + "stupid y z", "漢字 漢字 q"]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    (_, _, words), = toxicity._words.batch_words(batch, "text")
    got = toxicity.scores(words, values, bias)
    for text, score in zip(texts, got, strict=True):
        own = list(dict.fromkeys(brute.words(text)))
        parts = []
        for k in range(0, len(own), toxicity.WIDTH):
            _, rows = toxicity.subwords(own[k : k + toxicity.WIDTH])
            parts.append(values[rows].mean())
            grams = sum(max(len(w) + 2 - n + 1, 0) for w in own[k : k + toxicity.WIDTH] for n in toxicity.GRAMS) + len(own[k : k + toxicity.WIDTH])
            assert len(rows) == grams
        assert score == pytest.approx(1 / (1 + math.exp(-(max(parts, default=0.0) + bias))))


def test_quality_scores_and_learning_equal_plain_ones():
    texts = ["", "one", "a b a b. a!", "zeta eta theta eta zeta zeta zeta", "é é é"]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    (_, _, words), = quality._words.batch_words(batch, "text", quality._words.WORDS_AND_SIGNS)
    start, key, value = quality.bags(words)
    rows = [(key[a:b], value[a:b], i % 2) for i, (a, b) in enumerate(zip(start[:-1], start[1:], strict=True))]
    assert [len(r[0]) for r in rows] == [0, 1, 9, 9, 3] and all(sum(v * v) == pytest.approx(1) for _, v, _ in rows if len(v))
    learner = quality.Ftrl()
    weights, bias = learner.fit(rows, epochs=3)
    z, n, end = {}, {}, 1 << quality.BITS  # the plain update, one coordinate at a time

    def w(k):
        l1 = 0.0 if k == end else learner.l1
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((learner.beta + math.sqrt(n[k])) / learner.alpha + learner.l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(len(rows)).tolist():
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True), (end, 1.0)]
            now = {k: w(k) for k, _ in x}
            p = 1 / (1 + math.exp(-sum(now[k] * v for k, v in x)))
            for k, v in x:
                g = (p - rows[i][2]) * v
                step = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / learner.alpha
                z[k], n[k] = z.get(k, 0.0) + g - step * now[k], n.get(k, 0.0) + g * g
    assert bias == pytest.approx(w(end)) and all(weights[k] == pytest.approx(w(k)) for k in z if k != end)
    for (k, v, _), score in zip(rows, quality.scores(words, weights, bias), strict=True):
        assert score == pytest.approx(1 / (1 + math.exp(-(float(weights[k] @ v) + bias))))


def test_reply_trees_equal_plain_paths(spark):
    """Combs, chains and bushes: the best leaves by path score."""
    rng = random.Random(8)
    rows = []
    for tree in range(12):
        for node in range(40):
            parent = None if node == 0 else {0: node - 1, 1: max(0, node - 2)}.get(tree % 4, rng.randrange(node))
            rows.append((f"t{tree}", node, parent, "user", f"m{node}", rng.choice([None, 0.5, 1.0, 2.0])))
    df = spark.createDataFrame(rows, "tree_id string, message_id long, parent_id long, role string, text string, score double")
    got = {}
    for r in chat.format_trees(df, best=3).collect():
        got.setdefault(r["tree_id"], {})[r["rank"]] = (r["leaf_id"], re.findall(r"\nm(\d+)<", r["formatted"]))
    for tree in {r[0] for r in rows}:
        above = {n: (p, s or 0.0) for t, n, p, _, _, s in rows if t == tree}
        leaves = []
        for leaf in set(above) - {p for p, _ in above.values()}:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = above[at][0]
            leaves.append((-sum(above[n][1] for n in path), leaf, [str(n) for n in path[::-1]]))
        assert got[tree] == {i + 1: (leaf, path) for i, (_, leaf, path) in enumerate(sorted(leaves)[:3])}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", None, "a", 3), (None, "some words here", None, "a", 3), (3, "x " * 200_000, "en", "a", 9), (4, "x " * 200_000, "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("component_id", F.lit(1)).withColumn("kept", F.lit("x"))
    schemas = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = spark.createDataFrame(stage(spark, now, str(tmp_path)).toArrow(), now.select(corpus_pipeline.COLUMNS).schema)
            assert now.columns == corpus_pipeline.COLUMNS, name
        left = sorted(str(r["doc_id"]) for r in now.collect())
        assert left == (["1", "2", "3", "None", "None"] if table is docs else [])
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert sum(p["start"] == 0 for p in pieces) == len(left)


def test_learning_sample_keeps_the_mix_at_every_size(spark):
    for n in (1000, 20000):
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
        got = [r["y"] for r in _training.sample(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), "toxic", 2000).collect()]
        assert 700 < len(got) <= 2000 and 0.15 < sum(got) / len(got) < 0.25, (n, len(got), sum(got))


def test_packing(spark, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(docs, path, with_ids=True).collect()
    assert all(len(p["ids"]) == p["length"] for p in pieces) and nothing is not None
    whole = {}
    for p in pieces:
        whole[p["doc_id"]] = whole.get(p["doc_id"], 0) + p["length"]
    assert whole[1] == whole[2] == 1 and whole[4] == 4 and packing.pack(nothing, path).count() == 0


def test_packing_of_endless_runs(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, n = Tokenizer.from_file(path), packing.LONGEST_RUN
    runs = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "7" * 2_000_000, " " * n, " " * (n + 1), " \n\t" * n]
    texts = [x for r in runs for x in (f"a{r}b", r)]
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, with_ids=True).select("doc_id", "start", "ids").toArrow()
    for k, text in enumerate(texts):
        own = pieces.filter(pa.compute.equal(pieces["doc_id"], k)).sort_by("start")
        got = np.concatenate([x.values.to_numpy() for x in own["ids"]])
        assert np.array_equal(got, [*library.encode(text, add_special_tokens=False).ids, 0]), (k, text[:3])


def test_encoder_equals_library_on_odd_strings():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    library, encode = Tokenizer.from_file(path), packing.encoder(path)
    counted, count = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), tokencount.counter(public_tokenizers.path("word_bpe_49k.json")).count
    signs = ["a", "B", "é", "e\u0301", "7", " ", "  ", "\n", "\t", "'s", "'LL", "\u0130", "\x85", "\u200b", "\u3000", "😀", "\0", "<|endoftext|>", "<|startoftext|>", "<|", "the", "ing", ".", "!?", "漢字", "\x1c"]
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(24)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert count(text) == len(counted.encode(text, add_special_tokens=False).ids), text


def test_cuts_are_the_cheapest():
    """Against a plain quadratic dynamic program."""
    rng = np.random.default_rng(2)
    for length in (7, 8, 16):
        for _ in range(60):
            ends = np.cumsum(rng.integers(1, 3 * length, rng.integers(1, 12)))
            soft = rng.integers(1, ends[-1] + 1, rng.integers(0, 12))
            x, cost = packing.places(ends, soft, length, (2.0, 5.0))
            paid = lambda n: 0 if n & (n - 1) == 0 else length - n
            best = [0.0]
            for j in range(1, len(x)):
                best.append(cost[j] + min(best[i] + paid(int(x[j] - x[i])) for i in range(j) if x[j] - x[i] <= length))
            cuts = packing.choose_cuts(x, cost, length)
            total = sum(cost[b] + paid(int(x[b] - x[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            assert cuts[0] == 0 and cuts[-1] == len(x) - 1 and total == pytest.approx(best[-1])


def test_token_count_of_endless_words(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["a" * 50_000, "7" * 20_000, "é" * 20_000, " " * 2_000_000, "<|endoftext|>" * 3 + "x<|startoftext|>y"]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    library = Tokenizer.from_file(path)
    assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_token_counts(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, path).collect()}
    assert got[1] == got[2] == 0 and got[3] == 1 and got[None] == 3 and tokencount.count_tokens(nothing, path).count() == 0


def test_pipeline_stages(spark, sf_small):
    import corpus_pipeline
    from tests.llm.test_queries import check_pieces

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    work = Workspace(spark, "test-pipeline")
    bench = [(r["item_id"], r["text"]) for r in brute.rows(sf_small, "benchmark")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = work.write(stage(spark, docs, sf_small), name)
        after = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == corpus_pipeline.COLUMNS and after <= before.keys() and after
        if name == "near_duplicates":
            component = brute.components({k: brute.shingles(t, 5) for k, t in before.items()})
            assert after == {k for k, c in component.items() if k == c}
        if name == "decontamination":
            assert after == {k for k, t in before.items() if not brute.contamination(t, bench)[1]}
    pieces = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).collect()]
    check_pieces(pieces, [r.asDict() for r in docs.collect()])
