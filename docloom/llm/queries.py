"""The operators over their whole tables, with production parameters, and what SQL can say about their results."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import _training, bestfit, chat, decontaminate, licenses, neardup, packing, quality, spelling, tokencount, topk, toxicity, urlfilter, whitening

#: Fixed values of the url filter query: (host, path, verdict).
URL_RULES = (
    urlfilter.Rule("com", "/", "allow"), urlfilter.Rule("example.com", "/en/", "block"), urlfilter.Rule("www.example.com", "/en/", "allow"),
    urlfilter.Rule("net", "/es/", "block"), urlfilter.Rule("net", "/fr/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The conversation that the chat query adds to the table.
EXTRA_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select * from values " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in EXTRA_TURNS) + " as t(conv_id, turn, role, text)")
    done = chat.format_conversations(rows.unionByName(extra))
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=2)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _classified(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", _training.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _classified(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _classified(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def _misspelt(every: int = 199) -> Column:
    """The run, without one letter where ``every`` divides the checksum of document and run (a null id misspells nothing)."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = F.pmod(h, F.length("run")).cast("int")
    return F.when(h % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(spelling.letter_runs(table(spark, sf_dir, "documents")), _misspelt()))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": op1_top_k,
        "op2_chat_format": op2_chat_format,
        "op3_url_filter": op3_url_filter,
        "op4_license_scan": op4_license_scan,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_decontamination": op6_decontamination,
        "op7_toxicity": op7_toxicity,
        "op8_packing": op8_packing,
        "op9_token_counts": op9_token_counts,
        "op10_quality": op10_quality,
        "op11_whitening": op11_whitening,
        "op12_spelling": op12_spelling,
        "op13_best_fit": op13_best_fit,
    }


_LOW = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_NONSPACE = r"regexp_extract_all(" + _LOW + r", '[^\x20\x09-\x0D]+')"

OP1_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
  SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5"""


def _op2_sql() -> str:
    """Turns, loss and length of the format; an escape adds one sign."""
    escapes = lambda c: " + ".join(f"len(regexp_extract_all({c}, '{re.escape(x)}\\\\*(?:{rest})'))" for x, rest in chat._tails(chat.CONTROL))
    signs = len(chat.TURN) + len(chat.END) + 2
    extra = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in EXTRA_TURNS)
    role = "replace(replace(role, '\\', '\\b'), chr(10), '\\n')"
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(role = 'assistant', false) AS said FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {extra})))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (said), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (said), '')) AS loss_sha256,
    CAST(sum({signs} + length({role}) + {escapes(role)} + length(text) + {escapes('text')}) AS BIGINT) AS formatted_chars
  FROM r GROUP BY conv_id"""


def _op3_sql() -> str:
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)
    return f"""WITH p AS (SELECT row_number() OVER () AS n, page_id, coalesce({_LOW.format(c="regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  b AS (SELECT n, arg_max(r.host || r.path, strlen(r.host || r.path)) AS rule, arg_max(r.verdict, strlen(r.host || r.path)) AS verdict FROM p
    JOIN (VALUES {rules}) AS r(host, path, verdict) ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
  SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (n)"""


OP5_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_NONSPACE.format(c="coalesce(text, '')")} AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
  n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS x FROM s),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
  k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS id, doc_id AS other FROM n UNION SELECT r.id, k.b FROM r JOIN k ON k.a = r.other)
  SELECT doc_id, n AS n_shingles, m AS component_id, doc_id = m AS kept FROM n JOIN (SELECT id, min(other) AS m FROM r GROUP BY id) ON id = doc_id"""

OP6_SQL = f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_ALNUM.format(c="coalesce(text, '')")} AS w FROM documents),
  i AS (SELECT item_id, {_ALNUM.format(c="coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
  j AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
  k AS (SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS x FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM j)),
  g AS (SELECT n, s, size, array_to_string(w[s:s + size - 1], ' ') AS x FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM j) WHERE len(w) >= size)),
  h AS (SELECT n, s, size, item FROM g JOIN k USING (size, x)),
  p AS (SELECT n, count(DISTINCT place) AS n_hit FROM (SELECT n, unnest(range(s, s + size)) AS place FROM h) GROUP BY n),
  t AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM h) GROUP BY n)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN p USING (n) LEFT JOIN t USING (n)"""


#: The checksum goes bit by bit: each byte is followed by seven zeros, and every element shifts once.
OP12_SQL = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({_LOW.format(c="text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
  d AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY ALL),
  b AS (SELECT *, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM d),
  h AS (SELECT run, k, length(run) AS size, xor(list_reduce([4294967295] || flatten(list_transform(bytes, lambda x: [CAST(x AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h FROM b),
  w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % size AS INT)) || substr(run, CAST(h % size AS INT) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1 HAVING sum(k) >= 5 AND length(word) >= 6),
  e AS (SELECT word, n, unnest(list_distinct([word] || list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)))) AS key FROM w),
  p AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM e a JOIN e b USING (key) WHERE a.word <> b.word
    AND (length(a.word) <> length(b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i])) = 1)),
  f AS (SELECT word, n, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM p),
  g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN f ON f.word = w.word AND place = 1),
  t AS (SELECT word, word AS root, form AS next FROM g UNION ALL SELECT t.word, g.word, g.form FROM t JOIN g ON g.word = t.next)
  SELECT word, form, root, n, n_near, form_n FROM g JOIN t USING (word) WHERE next IS NULL"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others (models, tokenizers, automata with labels of their own) are tested against plain re-statements."""
    return {"op1_top_k": OP1_SQL, "op2_chat_format": _op2_sql(), "op3_url_filter": _op3_sql(), "op5_near_duplicates": OP5_SQL, "op6_decontamination": OP6_SQL, "op12_spelling": OP12_SQL}
