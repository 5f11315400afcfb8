"""Queries of chunk quality, citations, document types and structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scores
from docloom.functions import text as t
from docloom.operators import classify
from docloom.plans.registry import query
from docloom.plans.retrieval import STRIP, WORDS
from docloom.sources.tables import table

SETTINGS = "d.doc_id, d.text AS c, 'the introduction of ' || d.lang AS context, CASE d.doc_id % 2 WHEN 0 THEN 'academic' ELSE 'general' END AS kind"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_hits(c: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({c}, '{p}') AS INT)" for p in patterns) + ")"


def sql_any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


PARTS = "regexp_split_to_array(c, '[.!?]+')"


def tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+')"


def part_words(c: str) -> str:
    return f"list_distinct(list_filter({tokens(f'lower({c})')}, lambda w: regexp_full_match(w, '[a-z]{{4,}}')))"


def az(c: str) -> str:
    return f"list_filter({tokens(c)}, lambda w: regexp_full_match(w, '[a-zA-Z]+'))"


def _coherence() -> str:
    first, last = part_words(f"{PARTS}[1]"), part_words(f"{PARTS}[-1]")
    return f"""least(1, CASE WHEN len({PARTS}) > 1 AND len({first}) > 0 AND len({last}) > 0 THEN 0.4 * len(list_intersect({first}, {last})) / least(len({first}), len({last})) ELSE 0 END
  + least(0.3, {sql_hits('lower(c)', scores.CONNECTORS)} * 0.1) + CASE WHEN contains(c, chr(10) || chr(10)) THEN 0.2 ELSE 0 END)"""


INTEGRITY = f"""least(1, 0.4 * len(list_filter({PARTS}, lambda s: length({STRIP.format(c='s')}) > 10)) / len({PARTS}) + least(0.3, 2 * len(regexp_extract_all(c, '[.!?]')) / greatest(1, len({WORDS.format(c='c')})))
  + CASE WHEN contains(c, chr(10) || chr(10)) THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(c, '(?m)^\\s*[-*•]\\s+') THEN 0.1 ELSE 0 END)"""
_WORDS_LOW = az("lower(c)")
DENSITY = f"""CASE WHEN len({_WORDS_LOW}) = 0 THEN 0 ELSE len(list_filter({_WORDS_LOW}, lambda w: NOT list_contains({sql_list(scores.STOP)}, w) AND length(w) > 2)) / len({_WORDS_LOW}) * CASE WHEN len({_WORDS_LOW}) < 20 THEN 0.8 ELSE 1 END END"""
_MEAN = f"(list_sum(list_transform({PARTS}, lambda s: len({WORDS.format(c='s')}))) / len({PARTS}))"
_LETTERS = f"(list_sum(list_transform({az('c')}, lambda w: length(w))) / len({az('c')}))"
_PARAS = "string_split(c, chr(10) || chr(10))"
READABILITY = f"""least(1, CASE WHEN {_MEAN} BETWEEN 15 AND 25 THEN 0.4 WHEN {_MEAN} BETWEEN 10 AND 30 THEN 0.2 ELSE 0 END + CASE WHEN len({az('c')}) = 0 THEN 0 WHEN {_LETTERS} <= 6 THEN 0.3 WHEN {_LETTERS} <= 8 THEN 0.2 ELSE 0 END
  + 0.3 * len(list_filter({_PARAS}, lambda p: len(string_split({STRIP.format(c='p')}, '.')) >= 2)) / len({_PARAS}))"""
_KNOWN, _OWN = part_words("context"), part_words("c")
PRESERVATION = f"""least(1, CASE WHEN len({_KNOWN}) > 0 AND len({_OWN}) > 0 THEN least(0.6, len(list_intersect({_KNOWN}, {_OWN})) / len({_KNOWN})) ELSE 0 END + least(0.4, {sql_hits('lower(c)', scores.CONTEXT)} * 0.1))"""
_BODY = STRIP.format(c="c")
BOUNDARY = f"""least(1, CASE WHEN regexp_matches({_BODY}, '^\\p{{Lu}}') THEN 0.2 ELSE 0 END + CASE WHEN {sql_hits(_BODY, scores.HEADERS)} > 0 THEN 0.3 ELSE 0 END
  + CASE WHEN len({WORDS.format(c=PARTS + '[1]')}) >= 3 THEN 0.2 ELSE 0 END + CASE WHEN kind = 'academic' AND {sql_any('lower(c)', scores.ACADEMIC)} THEN 0.3 ELSE 0 END)"""
METRIC_SQL = {"semantic_coherence": _coherence(), "structural_integrity": INTEGRITY, "content_density": DENSITY, "readability": READABILITY, "context_preservation": PRESERVATION, "boundary_quality": BOUNDARY}
QUALITY_SQL = f"""(SELECT *, semantic_coherence * 0.25 + structural_integrity * 0.20 + content_density * 0.15 + readability * 0.15 + context_preservation * 0.15 + boundary_quality * 0.10 AS quality_score
  FROM (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in METRIC_SQL.items())} FROM (SELECT {SETTINGS} FROM documents d)))"""
STATUS_SQL = "CASE WHEN {s} >= 0.85 THEN 'excellent' WHEN {s} >= 0.70 THEN 'good' WHEN {s} >= 0.50 THEN 'fair' WHEN {s} >= 0.30 THEN 'poor' ELSE 'unusable' END"


def quality(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, six metrics, quality_score)."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", F.lower("text").alias("low")).withColumn("az", scores.az_words(F.col("low")))
    kind = F.when(F.col("doc_id") % 2 == 0, "academic").otherwise("general")
    m = scores.chunk_quality(F.col("text"), F.concat(F.lit("the introduction of "), F.col("lang")), kind, F.col("low"), F.col("az"))
    each = d.select("doc_id", *[c.alias(k) for k, c in m.items()])
    return each.withColumn("quality_score", scores.weighted({k: F.col(k) for k in m}, scores.QUALITY_WEIGHTS))


def _metric(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return quality(spark, sf).select("doc_id", F.round(name, 6).alias("score"))

    run.__name__ = {"semantic_coherence": "coherence"}.get(name, name)
    return query(f"SELECT doc_id, round({METRIC_SQL[name]}, 6) AS score FROM (SELECT {SETTINGS} FROM documents d)")(run)


for _name in METRIC_SQL:
    _metric(_name)


@query(f"SELECT doc_id, round(quality_score, 6) AS quality_score, {STATUS_SQL.format(s='round(quality_score, 9)')} AS status FROM {QUALITY_SQL}")
def quality_total_status(spark: SparkSession, sf: str) -> DataFrame:
    q = quality(spark, sf)
    return q.select("doc_id", F.round("quality_score", 6).alias("quality_score"), scores.status(F.round("quality_score", 9), scores.QUALITY_STATUS).alias("status"))


@query(f"""WITH s AS (SELECT {STATUS_SQL.format(s='round(quality_score, 9)')} AS status, quality_score FROM {QUALITY_SQL}) SELECT d.status, count(s.status) AS n, round(avg(s.quality_score), 6) AS mean
  FROM (SELECT unnest(['excellent', 'good', 'fair', 'poor', 'unusable']) AS status) d LEFT JOIN s USING (status) GROUP BY d.status""")
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = quality(spark, sf).withColumn("status", scores.status(F.round("quality_score", 9), scores.QUALITY_STATUS))
    return classify.report(scored, "status", "quality_score", [k for k, _ in scores.QUALITY_STATUS]).withColumn("mean", F.round("mean", 6))


@query(f"""SELECT suggestion, count(*) AS n FROM (SELECT unnest(list_filter([{', '.join(f"CASE WHEN round({k}, 9) < 0.5 THEN '{v}' END" for k, v in scores.QUALITY_TIPS.items())}], lambda x: x IS NOT NULL)) AS suggestion FROM {QUALITY_SQL}) GROUP BY suggestion ORDER BY n DESC, suggestion LIMIT 5""")
def quality_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return classify.suggestion_counts(quality(spark, sf), {tip: F.round(k, 9) < 0.5 for k, tip in scores.QUALITY_TIPS.items()})


_CITE = "d.doc_id, 'According to source document ' || d.source || ', page ' || CAST(d.doc_id % 9 AS VARCHAR) || ' of Section 2 [3]: ' || d.text AS c, d.source AS source, [CAST(d.doc_id % 5 AS INT)] AS pages, d.lang AS title"
PRESENCE_SQL = f"least(1, 0.25 * (CAST(contains(lower(c), lower(source)) AS INT) + CAST(contains(lower(c), source) AS INT) + {sql_hits('lower(c)', scores.SOURCE_NAMES)} + {sql_hits('lower(c)', scores.ATTRIBUTIONS)}))"
FORMAT_SQL = "least(1, " + " + ".join(f"CASE WHEN {sql_hits('c', p)} > 0 THEN {w} ELSE 0 END" for w, p in scores.FORMATS) + f" + CASE WHEN {sql_hits('lower(c)', scores.FORMATS_LOWER)} > 0 THEN 0.2 ELSE 0 END)"
RELEVANCE_SQL = "least(1, " + " + ".join(f"{w} * {sql_hits('lower(c)', p)}" for w, p in scores.RELEVANCE) + ")"
_NAMED = "list_transform(regexp_extract_all(lower(c), '(?:page|p\\.?)\\s*(\\d+)', 1), lambda x: TRY_CAST(x AS INT))"
POSITION_SQL = f"""least(1, CASE WHEN list_has_any({_NAMED}, pages) THEN 0.4 WHEN len({_NAMED}) > 0 THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(c), lower(title)) THEN 0.3 ELSE 0 END
  + CASE WHEN {sql_hits('lower(c)', scores.SECTION_LIKE)} > 0 THEN 0.2 ELSE 0 END + 0.1 * {sql_hits('lower(c)', scores.POSITIONS)})"""
COMPLETE_SQL = f"""(CAST({PRESENCE_SQL} > 0 AS INT) + CAST(regexp_matches(lower(c), '(?:page|p\\.?)\\s*\\d+') AS INT) + CAST(contains(lower(c), lower(title)) OR regexp_matches(lower(c), '{scores.SECTION_LIKE[0]}') AS INT)) / 3.0"""
CITATION_SQL = f"""(SELECT *, source_presence * 0.3 + citation_format * 0.25 + context_relevance * 0.2 + position_accuracy * 0.15 + completeness * 0.1 AS confidence FROM (SELECT doc_id, {PRESENCE_SQL} AS source_presence,
  {FORMAT_SQL} AS citation_format, {RELEVANCE_SQL} AS context_relevance, {POSITION_SQL} AS position_accuracy, {COMPLETE_SQL} AS completeness FROM (SELECT {_CITE} FROM documents d)))"""
CITE_STATUS = "CASE WHEN round(confidence, 9) >= 0.8 THEN 'valid' WHEN round(confidence, 9) >= 0.6 THEN 'partial' WHEN round(confidence, 9) >= 0.3 THEN 'unverifiable' ELSE 'invalid' END"


def citations(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("According to source document "), F.col("source"), F.lit(", page "), (F.col("doc_id") % 9).cast("string"), F.lit(" of Section 2 [3]: "), F.col("text"))
    m = scores.citation(text, F.col("source"), F.array((F.col("doc_id") % 5).cast("int")), F.col("lang"))
    each = d.select("doc_id", *[c.alias(k) for k, c in m.items()])
    return each.withColumn("confidence", scores.weighted({k: F.col(k) for k in m}, scores.CITATION_WEIGHTS))


@query(f"""SELECT doc_id, {', '.join(f'round({k}, 6) AS {k}' for k in [*scores.CITATION_WEIGHTS, 'confidence'])}, {CITE_STATUS} AS status FROM {CITATION_SQL}""")
def citation_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf)
    return c.select("doc_id", *[F.round(k, 6).alias(k) for k in [*scores.CITATION_WEIGHTS, "confidence"]], scores.status(F.round("confidence", 9), scores.CITATION_STATUS).alias("status"))


@query(f"""WITH s AS (SELECT {CITE_STATUS} AS status, confidence FROM {CITATION_SQL}) SELECT d.status, count(s.status) AS n, round(avg(s.confidence) * 100, 4) AS quality_score
  FROM (SELECT unnest(['valid', 'partial', 'unverifiable', 'invalid']) AS status) d LEFT JOIN s USING (status) GROUP BY d.status""")
def citation_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = citations(spark, sf).withColumn("status", scores.status(F.round("confidence", 9), scores.CITATION_STATUS))
    return classify.report(scored, "status", "confidence", [k for k, _ in scores.CITATION_STATUS]).select("status", "n", F.round(F.col("mean") * 100, 4).alias("quality_score"))


_VERIFIED = f"""(SELECT *, contains(lower(c), lower(source)) OR regexp_matches(lower(c), '{scores.SOURCE_NAMES[0]}') AS document_name, regexp_matches(lower(c), '(?:page|p\\.?)\\s*\\d+') AS page_numbers, contains(lower(c), lower(title)) AS section_title,
  {FORMAT_SQL} > 0.3 AS citation_format_ok FROM (SELECT {_CITE} FROM documents d))"""
_FLAGS = {"document_name": "document_name", "page_numbers": "page_numbers", "section_title": "section_title", "citation_format": "citation_format_ok"}


@query(f"""SELECT doc_id, v.document_name, v.page_numbers, v.section_title, v.citation_format_ok, list_filter([{', '.join(f"CASE WHEN round(s.{k}, 9) < {least} THEN '{tip}' END" for k, (least, tip) in scores.CITATION_TIPS.items())},
  CASE WHEN round(s.completeness, 9) < 0.7 AND NOT ({' AND '.join('v.' + x for x in _FLAGS.values())}) THEN 'add ' || array_to_string(list_filter([{', '.join(f"CASE WHEN NOT v.{x} THEN '{k}' END" for k, x in _FLAGS.items())}], lambda x: x IS NOT NULL), ', ') END], lambda x: x IS NOT NULL) AS advice
  FROM {CITATION_SQL} s JOIN {_VERIFIED} v USING (doc_id)""")
def citation_verification(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("According to source document "), F.col("source"), F.lit(", page "), (F.col("doc_id") % 9).cast("string"), F.lit(" of Section 2 [3]: "), F.col("text"))
    args = (text, F.col("source"), F.array((F.col("doc_id") % 5).cast("int")), F.col("lang"))
    scored = d.select("doc_id", *[c.alias(k) for k, c in scores.citation(*args).items()], text.alias("c"), *[a.alias(n) for a, n in zip(args[1:], ("source", "pages", "title"), strict=True)])
    found = scores.verification(*(F.col(x) for x in ("c", "source", "pages", "title", "citation_format")))
    flagged = scored.select("*", *[v.alias(_FLAGS[k]) if k == "citation_format" else v.alias(k) for k, v in found.items()])
    advice = scores.citation_advice({k: F.col(k) for k in scores.CITATION_WEIGHTS}, {k: F.col(x) for k, x in _FLAGS.items()})
    return flagged.select("doc_id", *_FLAGS.values(), advice.alias("advice"))


@query(f"SELECT metric, round(mean, 6) AS mean FROM (SELECT {', '.join(f'avg({k}) AS {k}' for k in METRIC_SQL)} FROM {QUALITY_SQL}) UNPIVOT (mean FOR metric IN ({', '.join(METRIC_SQL)}))")
def quality_metric_means(spark: SparkSession, sf: str) -> DataFrame:
    means = quality(spark, sf).agg(*[F.avg(k).alias(k) for k in METRIC_SQL])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(k, 6).alias("mean")) for k in METRIC_SQL])).alias("x")).select("x.*")


_TOK = tokens("lower(coalesce(title, '') || ' ' || text)")


@query(f"""WITH w AS (SELECT doc_id, unnest({_TOK}) AS w FROM (SELECT doc_id, source || ' report on market' AS title, text || ' the data analysis of patient treatment and policy' AS text FROM documents)),
  k AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{w}', {i})" for k, ws in scores.TYPES.items() for i, w in enumerate(ws))}) AS k(document_type, w, i)),
  c AS (SELECT doc_id, document_type, count(*) AS n, count(*) FILTER (WHERE i < 10) AS top10 FROM w JOIN k USING (w) GROUP BY 1, 2)
  SELECT d.doc_id, t.document_type, CAST(coalesce(c.n, 0) AS INT) AS count, CAST(coalesce(c.top10, 0) AS INT) AS top10 FROM documents d CROSS JOIN (SELECT unnest({sql_list(list(scores.TYPES))}) AS document_type) t LEFT JOIN c ON c.doc_id = d.doc_id AND c.document_type = t.document_type""")
def keyword_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(" report on market")).alias("title"), F.concat("text", F.lit(" the data analysis of patient treatment and policy")).alias("text"))
    return classify.keyword_counts(d).select("doc_id", "document_type", "count", "top10")


def _any_int(words: list[str]) -> str:
    return f"CAST({sql_any('low', words)} AS INT)"


def _features_sql(title: str) -> str:
    """(doc_id, elements and words of each kind, depth, variety) of documents as one chunk each."""
    cols = [f"{_any_int(ws)} AS {k}_e" for k, ws in scores.ELEMENT_WORDS.items()] + [f"{_any_int(ws)} AS {k}_w" for k, ws in scores.PATTERN_WORDS.items()]
    depth = f"CASE WHEN regexp_matches({title}, '^\\d+(?:\\.\\d+)*') THEN len(string_split(regexp_extract({title}, '^(\\d+(?:\\.\\d+)*)', 1), '.')) WHEN regexp_matches({title}, '^([IVXLCDM]+|[A-Z])\\.') THEN 1 ELSE 0 END"
    return f"(SELECT doc_id, {', '.join(cols)}, {depth} AS depth, CASE WHEN {title} IS NULL THEN 0 ELSE 1 END AS variety FROM (SELECT doc_id, source, lower(text) AS low FROM documents))"


_KEYWORDS = "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{w}', {i}, {rank})" for rank, (k, ws) in enumerate(scores.TYPES.items()) for i, w in enumerate(ws)) + ") AS k(document_type, w, i, rank))"
_TYPED = f"""(WITH f AS {_features_sql('source')}, t AS (SELECT doc_id, coalesce(source, '') AS title, unnest({tokens("lower(coalesce(source || ' ', '') || text)")}) AS w FROM documents),
  n AS (SELECT doc_id, document_type, count(*) AS n, count(*) FILTER (i < 10) AS top10 FROM t JOIN {_KEYWORDS} USING (w) GROUP BY 1, 2), a AS (SELECT doc_id, sum(n) AS total FROM n GROUP BY 1),
  d AS (SELECT unnest({sql_list(list(scores.TYPES))}) AS document_type, unnest(range(0, {len(scores.TYPES)})) AS rank)
  SELECT d.document_type, d.rank, f.doc_id, least(1, coalesce(n.n, 0) / greatest(coalesce(total, 0), 1) * 0.4 + least(coalesce(top10, 0) / 10, 1) * 0.3
    + CASE {' '.join(f"WHEN d.document_type = '{k}' THEN " + (' + '.join(f"least({'depth / 3' if p == 'section_hierarchy' else p + '_e / 5' if p + '_e' in ('procedural_e', 'argumentative_e', 'descriptive_e') else '0'}, 1) * 0.25" for p in ps) or '0') for k, ps in scores.EXPECTED.items())} END * 0.2
    + CASE {' '.join(f"WHEN d.document_type = '{k}' AND {sql_any('lower(s.source)', ws[:5])} THEN 0.05" for k, ws in scores.TYPES.items() if ws)} ELSE 0 END) AS confidence
  FROM f CROSS JOIN d JOIN documents s ON s.doc_id = f.doc_id LEFT JOIN n ON n.doc_id = f.doc_id AND n.document_type = d.document_type LEFT JOIN a ON a.doc_id = f.doc_id)"""
_PRIMARY = f"(SELECT doc_id, document_type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(confidence, 9) DESC, rank) AS place FROM {_TYPED}) WHERE place = 1)"


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("title"))
    chunks = d.select("doc_id", F.col("text").alias("chunk_text"), F.col("title").alias("section_title"))
    return classify.classify(classify.keyword_counts(d), classify.features(chunks)).where("place = 1")


@query(f"SELECT doc_id, document_type, round(confidence, 6) AS confidence, CAST(1 AS INT) AS place FROM {_PRIMARY}")
def document_types(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).withColumn("confidence", F.round("confidence", 6))


_PATTERNS = f"""(SELECT doc_id, pattern, confidence FROM (SELECT doc_id, unnest(['section_hierarchy', 'procedural', 'argumentative', 'descriptive', 'comparative', 'narrative']) AS pattern,
  unnest([least(depth * 0.3 + variety * 0.1, 1), {', '.join(f"least({k}_e * 0.2 + {k}_w * 0.1, 1)" for k in ('procedural', 'argumentative', 'descriptive'))}, {', '.join(f"least({k}_w * 0.2, 1)" for k in ('comparative', 'narrative'))}]) AS confidence
  FROM {_features_sql("'1.2 Scope'")}) WHERE round(confidence, 9) > 0.3)"""


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "documents").select("doc_id", F.col("text").alias("chunk_text"), F.lit("1.2 Scope").alias("section_title"))
    return classify.pattern_confidence(classify.features(chunks))


@query(f"SELECT doc_id, pattern, round(confidence, 6) AS confidence FROM {_PATTERNS}")
def structure_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _patterns(spark, sf).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH c AS (SELECT 'type' AS dimension, document_type AS value FROM {_PRIMARY} UNION ALL SELECT 'pattern', pattern FROM {_PATTERNS}), n AS (SELECT dimension, value, count(*) AS n FROM c GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) = 1 AS most_common FROM n""")
def type_distributions(spark: SparkSession, sf: str) -> DataFrame:
    return classify.distributions(_typed(spark, sf), _patterns(spark, sf))


def _level_sql(x: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"regexp_matches({x}, '(?i){p}')" for p in t.HEADINGS[k]) + f" THEN {k}" for k in (1, 2, 3)) + " END"


_HEAD_TITLE = f"CASE WHEN regexp_matches(x, '^#{{1,3}}\\s+(.+)$') THEN {STRIP.format(c="regexp_extract(x, '^#{1,3}\\s+(.+)$', 1)")} ELSE x END"
_MARK = "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(x, '(?i){p}', 1), '') AS INT)" for p in t.PAGES_STRUCTURE) + ")"
_LINES = f"""(SELECT *, last_value(CASE WHEN mark BETWEEN 1 AND 1000 THEN mark END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS page, CAST({_level_sql('x')} AS INT) AS level, {_HEAD_TITLE} AS title
  FROM (SELECT doc_id, CAST(line AS INT) AS line, x, {_MARK} AS mark FROM (SELECT doc_id, line, {STRIP.format(c='raw')} AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents))))"""
_UPPER = "upper(title) = title AND lower(title) <> title"
_HEADS = f"""(SELECT *, CASE level WHEN 2 THEN l1 WHEN 3 THEN greatest(l1, l2) END AS parent FROM (SELECT *, last_value(CASE WHEN level = 1 THEN line END IGNORE NULLS) OVER w AS l1, last_value(CASE WHEN level = 2 THEN line END IGNORE NULLS) OVER w AS l2,
  greatest(0.1, least(1, 0.5 + CASE WHEN length(title) BETWEEN 10 AND 100 THEN 0.2 WHEN length(title) > 100 THEN -0.1 ELSE 0 END + CASE WHEN {_UPPER} THEN 0.1 ELSE 0 END + CASE WHEN title LIKE '%:' THEN 0.1 ELSE 0 END + CASE WHEN level = 1 AND {_UPPER} THEN 0.2 ELSE 0 END)) AS confidence
  FROM {_LINES} WHERE level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


@query(f"SELECT doc_id, line, level, title, round(confidence, 6) AS confidence, CAST(page AS INT) AS page, parent FROM {_HEADS}")
def structure_lines(spark: SparkSession, sf: str) -> DataFrame:
    return classify.hierarchy(classify.structure_lines(table(spark, sf, "documents"))).withColumn("confidence", F.round("confidence", 6))


_HINTS = {"academic_paper": ["paper", "thesis"], "legal_document": ["contract", "agreement"], "technical_manual": ["manual", "guide"], "business_report": ["report"]}
_STRUCT_COUNT = {k: "(" + " + ".join(f"CAST(len(list_filter({tokens('low')}, lambda w: w = '{w}')) > 0 AS INT)" if " " not in w else f"CAST(regexp_matches(' ' || low || ' ', '[^\\p{{L}}\\p{{N}}_]{w}[^\\p{{L}}\\p{{N}}_]') AS INT)" for w in ws) + f" + CASE WHEN {sql_any('name', _HINTS[k])} THEN 2 ELSE 0 END)" for k, ws in scores.STRUCTURES.items()}


@query(f"""WITH b AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _STRUCT_COUNT.items())} FROM (SELECT doc_id, lower(text) AS low, lower(coalesce(source, '')) AS name FROM documents)),
  y AS (SELECT doc_id, CASE WHEN m = 0 THEN 'unknown' {' '.join(f"WHEN {k} = m THEN '{k}'" for k in _STRUCT_COUNT)} END AS document_type FROM (SELECT *, greatest({', '.join(_STRUCT_COUNT)}) AS m FROM b)),
  p AS (SELECT doc_id, count(*) FILTER (mark BETWEEN 1 AND 1000) AS page_count FROM {_LINES} GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS roots, avg(confidence) AS mean FROM {_HEADS} WHERE parent IS NULL GROUP BY doc_id),
  c AS (SELECT doc_id, document_type, CAST(page_count AS INT) AS page_count, coalesce(roots, 0) AS roots, coalesce(mean, 0.1) AS s, CASE WHEN page_count > 0 THEN least(page_count / 10, 1) ELSE 0.1 END AS p, CASE document_type WHEN 'unknown' THEN 0.3 ELSE 0.8 END AS y FROM y JOIN p USING (doc_id) LEFT JOIN r USING (doc_id))
  SELECT doc_id, document_type, page_count, roots, round(s, 6) AS section_confidence, round(p, 6) AS page_confidence, y AS type_confidence, round(0.4 * s + 0.3 * p + 0.3 * y, 6) AS overall FROM c""")
def structure_analysis(spark: SparkSession, sf: str) -> DataFrame:
    s = classify.structure(table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("filename")))
    return s.select("doc_id", "document_type", "page_count", "roots", *[F.round(c, 6).alias(c) for c in ("section_confidence", "page_confidence", "type_confidence", "overall")])


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text[1:1000], '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY 1, 2), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n)
  SELECT doc_id, round(-sum(p * log2(p)), 5) AS entropy FROM p GROUP BY doc_id""")
def text_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.round(t.entropy(F.substring("text", 1, 1000)), 5).alias("entropy"))
