"""Text as columns: words, lines, sentences, pages, titles, headings, clause and step types."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number patterns by use, in order of trial.
PAGES_META = [r"(?is)<!--\s*PAGE:\s*([^>]+?)\s*-->", r"(?is)<!--\s*PAGE:\s*(\d+)", r"(?is)<!--.*?page.*?(\d+).*?-->", r"(?is)page\s*:\s*(\d+)", r"(?is)pages?\s*:\s*(\d+)"]
PAGES_FULL = [r"page\s+(\d+)", r"p\.\s*(\d+)", r"pp\.\s*(\d+)", r"pg\.\s*(\d+)", r"^\s*(\d+)\s*$", r"\(page\s+(\d+)\)", r"\[page\s+(\d+)\]", r"-\s*(\d+)\s*-", r"\|.*?(\d+).*?\|"]
PAGES_LIGHT = [r"---\s*Page\s+(\d+)\s*---", r"page\s+(\d+)", r"p\.\s*(\d+)"]
PAGES_QUERY = [r"page\s+(\d+)", r"p\.\s*(\d+)", r"pp\.\s*(\d+)", r"pg\.\s*(\d+)", r"\(page\s+(\d+)\)", r"\[page\s+(\d+)\]"]
PAGES_STRUCTURE = [r"\bpage\s+(\d+)\b", r"\bp\.?\s*(\d+)\b", r"^\s*(\d+)\s*$", r"^-\s*(\d+)\s*-$"]
# Title patterns.
TITLES_META = [r"(?is)<!--\s*SECTION:\s*([^>]+?)\s*-->", r"(?is)<!--.*?section.*?([^>]+?)\s*-->", r"(?is)<!--.*?title.*?([^>]+?)\s*-->", r"(?is)section\s*:\s*([^<\n]+)", r"(?is)title\s*:\s*([^<\n]+)"]
TITLES_LINE = [
    r"^\s*(\d+\.\d+\.?\s+.+?)\s*$", r"^\s*(\d+\.\s+.+?)\s*$", r"^\s*(Chapter\s+\d+\.?\s+.+?)\s*$", r"^\s*(Section\s+\d+\.?\s+.+?)\s*$", r"^\s*(Part\s+\d+\.?\s+.+?)\s*$",
    r"^\s*(Article\s+\d+\.?\s+.+?)\s*$", r"^\s*([A-Z]\.\s+.+?)\s*$", r"^\s*([IVX]+\.\s+.+?)\s*$", r"^\s*(\d+\)\s+.+?)\s*$", r"^\s*([A-Z][^.!?]*[A-Z])\s*$", r"^\s*PARTIE\s+(\d+)",
    r"^\s*#\s+(.+?)\s*$", r"^\s*##\s+(.+?)\s*$",
]
TITLES_LIGHT = [r"^\s*(\d+\.\d+\.?\s+.+?)\s*$", r"^\s*(\d+\.\s+.+?)\s*$", r"^\s*([A-Z][^.!?]*[A-Z])\s*$", r"^\s*#\s+(.+?)\s*$"]
CAPTIONS = [r"(?i)(?:Table|Figure|Fig\.|Tableau)\s+\d+\.?\s*:?\s*(.+?)(?:\n|$)", r"(?i)(?:Chart|Graph|Diagram|Graphique|Diagramme)\s+\d+\.?\s*:?\s*(.+?)(?:\n|$)"]
# Heading patterns by level, ignoring case.
HEADINGS = {
    1: [r"^#\s+(.+)$", r"^[A-Z][A-Z\s]{10,}$", r"^\d+\.\s+[A-Z][^a-z]{20,}$", r"^[IVX]+\.\s+[A-Z][^a-z]{15,}$"],
    2: [r"^##\s+(.+)$", r"^\d+\.\d+\s+.+$", r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$", r"^[A-Z][^.]{5,50}[.:]$"],
    3: [r"^###\s+(.+)$", r"^\d+\.\d+\.\d+\s+.+$", r"^[a-z][^.]{5,40}[.:]$"],
}
# Keyword cascades, first hit wins.
CLAUSES = [
    ("recital", ["whereas", "recital"]), ("party_definition", ["party", "parties"]), ("term", ["term", "duration", "effective date"]), ("confidentiality", ["confidential", "proprietary"]),
    ("liability", ["indemnify", "liability", "warranty"]), ("termination", ["terminate", "breach", "default"]),
]
STEPS = [
    ("installation", ["install", "setup", "configure"]), ("connection", ["connect", "attach", "plug"]), ("verification", ["test", "verify", "check"]),
    ("troubleshooting", ["troubleshoot", "debug", "fix"]), ("safety", ["warning", "caution", "danger"]),
]
NO_TITLE = ("http", "www.", "![", "img-")


def let(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` names it (inside lambdas, too)."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(c: Column) -> Column:
    """Without white space at both ends (not only blanks); a long run of blanks inside costs nothing."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def parts(c: Column) -> Column:
    """What stands between runs of sentence ends, empty ends included."""
    return F.split(c, "[.!?]+")


def token_count(c: Column) -> Column:
    """How many words, without listing them."""
    return F.regexp_count(c, F.lit(r"\S+"))


def any_of(c: Column, found: list[str]) -> Column:
    """Whether one of the substrings occurs."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in found])


def hits(c: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur; a pattern is only tried where the plain words that it must hold occur."""
    return reduce(lambda a, b: a + b, [F.coalesce((reduce(lambda x, y: x & y, [F.contains(c, F.lit(w)) for w in sure_words(p)], F.lit(True)) & _occurs(c, p)).cast("int"), F.lit(0)) for p in patterns])


def sure_words(pattern: str) -> list[str]:
    """The longest word that every match of a pattern of words, white space and digits holds, word borders around it or not (other patterns: none)."""
    pattern = re.sub(r"^\(\?U\)\\b(.*)\\b$", r"\1", pattern)
    if not re.fullmatch(r"(?:[A-Za-z :]|\\s\+|\\d\+)+", pattern):
        return []
    return [max(re.split(r"\\s\+|\\d\+", pattern), key=len)]


def _occurs(c: Column, pattern: str) -> Column:
    return F.lit(True) if sure_words(pattern) == [pattern] else F.rlike(c, F.lit(steady(pattern)))


def steady(pattern: str) -> str:
    """A pattern that finds the same without a call for every repetition: Java's matcher overflows its stack in a line of thousands of words.

    The repeated pieces below cannot give back a sign that what follows them could take, so they need not try.
    """
    for loop, kept in ((r"(?:\s+[A-Z][a-z]+)*", r"(?:\s++[A-Z][a-z]++)*+"), (r"(?:,\s*\d+)*", r"(?:,\s*+\d++)*+"), (r"(?:\.\d+)*", r"(?:\.\d++)*+")):
        pattern = pattern.replace(loop, kept)
    return pattern


def cascade(c: Column, table: list[tuple[str, list[str]]], other: str) -> Column:
    low, out = F.lower(c), F.lit(other)
    for name, found in reversed(table):
        out = F.when(any_of(low, found), F.lit(name)).otherwise(out)
    return out


def clause_type(c: Column) -> Column:
    return cascade(c, CLAUSES, "general")


def step_type(c: Column) -> Column:
    return cascade(c, STEPS, "instruction")


def first_group(c: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, 1))


def _numbers(c: Column, patterns: list[str], most: int) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(f"(?i){p}"), F.lit(1)) for p in patterns]))
    numbers = F.transform(found, lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= most))))


def pages_light(c: Column) -> Column:
    """Sorted distinct page numbers 1 to 1000."""
    return _numbers(c, PAGES_LIGHT, 1000)


def pages_of_query(c: Column) -> Column:
    return _numbers(c, PAGES_QUERY, 10000)


def pages_full(c: Column) -> Column:
    """Comma-joined page numbers: a metadata comment's digits, else all page patterns, else page-like short lines among the first 15; null if none."""
    meta = F.coalesce(*[F.nullif(F.array_join(F.regexp_extract_all(first_group(c, p), F.lit(r"(\d+)"), F.lit(1)), ","), F.lit("")) for p in PAGES_META])
    found = F.nullif(F.array_join(_numbers(c, PAGES_FULL, 10000).cast("array<string>"), ","), F.lit(""))
    short = F.filter(
        F.transform(F.slice(lines(strip(c)), 1, 15), strip),
        lambda x: (F.length(x) < 100) & any_of(F.lower(x), ["page", "p.", "pg.", "partie", "section"]) & F.rlike(x, F.lit(r"\d")),
    )
    near = F.flatten(F.transform(short, lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))))
    near = F.array_sort(F.array_distinct(F.filter(F.transform(near, lambda n: n.try_cast("int")), lambda n: (n >= 1) & (n <= 10000))))
    return F.coalesce(meta, found, F.nullif(F.array_join(near.cast("array<string>"), ","), F.lit("")))


def page_list(c: Column) -> Column:
    """Integers of a comma-joined string; other parts drop out."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.when(F.rlike(strip(x), F.lit(r"^\d+$")), strip(x).try_cast("int"))), lambda n: n.isNotNull())


def _line_title(found: Column, patterns: list[str], least: int = 3, most: int = 200) -> Column:
    """The first title that one of the patterns takes from a line, lines first."""
    titles = F.transform(found, lambda x: F.filter(F.array(*[strip(first_group(x, f"(?i){p}")) for p in patterns]), lambda t: (F.length(t) > least) & (F.length(t) < most)))
    return F.get(F.filter(F.flatten(titles), lambda t: t.isNotNull()), 0)


def title_light(c: Column) -> Column:
    """Section title: a header pattern in the first five lines, else a title-like line of the first three; null if none."""
    rows = F.transform(lines(strip(c)), strip)
    header = _line_title(F.filter(F.slice(rows, 1, 5), lambda x: F.length(x) >= 3), TITLES_LIGHT)
    like = F.filter(F.slice(rows, 1, 3), lambda x: (F.length(x) > 8) & (F.length(x) < 150) & F.rlike(x, F.lit(r"^\p{Lu}")) & ~any_of(F.lower(x), list(NO_TITLE)))
    return F.coalesce(header, F.get(like, 0))


def title_full(c: Column) -> Column:
    """Section title: metadata, then header patterns over twelve lines, then a title-like line of the first eight; at most 200 characters."""
    def clean(t: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"[^\p{L}\p{N}_\s\-.,()&]", "")
        return F.when(F.length(t) > 3, F.substring(t, 1, 200))

    rows = F.transform(lines(strip(c)), strip)
    header = _line_title(F.filter(F.slice(rows, 1, 12), lambda x: F.length(x) >= 3), TITLES_LINE)
    like = F.filter(F.slice(rows, 1, 8), lambda x: (F.length(x) > 8) & (F.length(x) < 150) & F.rlike(x, F.lit(r"^\p{Lu}")) & ~any_of(F.lower(x), list(NO_TITLE)))
    return F.coalesce(*[clean(strip(first_group(c, p))) for p in TITLES_META], header, F.get(like, 0), *[_caption(c, p) for p in CAPTIONS])


def _caption(c: Column, pattern: str) -> Column:
    t = strip(first_group(c, pattern))
    return F.when((F.length(t) > 5) & (F.length(t) < 100), t)


def is_heading(line: Column, level: int) -> Column:
    """Whether one of a level's heading patterns fits."""
    return reduce(lambda a, b: a | b, [F.rlike(line, F.lit(f"(?i){steady(p)}")) for p in HEADINGS[level]])


def heading_level(line: Column) -> Column:
    """1 to 3 by the heading patterns, null for other lines."""
    out = F.lit(None).cast("int")
    for level in (3, 2, 1):
        out = F.when(is_heading(line, level), F.lit(level)).otherwise(out)
    return out


def heading_title(line: Column) -> Column:
    marked = F.regexp_extract(line, r"^#{1,3}\s+(.+)$", 1)
    return F.when(marked != "", strip(marked)).otherwise(strip(line))


def heading_confidence(title: Column, level: Column) -> Column:
    size, upper = F.length(title), (F.upper(title) == title) & (F.lower(title) != title)
    score = F.lit(0.5) + F.when(size.between(10, 100), 0.2).when(size > 100, -0.1).otherwise(0.0) + F.when(upper, 0.1).otherwise(0.0)
    score = score + F.when(F.endswith(title, F.lit(":")), 0.1).otherwise(0.0) + F.when((level == 1) & upper, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), score))


def page_marker(line: Column) -> Column:
    """The page number (1 to 1000) that a line marks by the first pattern that fits, else null."""
    n = F.coalesce(*[first_group(line, f"(?i){p}").try_cast("int") for p in PAGES_STRUCTURE])
    return F.when(F.rlike(line, F.lit("[0-9]")) & n.between(1, 1000), n)  # most lines hold no digit


def section_depth(title: Column) -> Column:
    """Dotted numbers: how many; roman numeral or letter: 1; else 0."""
    number = F.regexp_extract(title, steady(r"^(\d+(?:\.\d+)*)"), 1)
    return F.when(number != "", F.size(F.split(number, r"\."))).when(F.rlike(title, F.lit(r"^([IVXLCDM]+|[A-Z])\.")), 1).otherwise(0)


def json_ints(c: Column) -> Column:
    """The integers of a JSON array text; anything else is an empty array."""
    return F.coalesce(F.from_json(c, "array<int>"), F.array().cast("array<int>"))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of the characters of a short text (a sample): they are sorted once, runs of equal ones counted."""

    def bits(chars: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(chars), F.lit(1))), lambda i: (i == F.size(chars)) | (F.get(chars, i) != F.get(chars, i - 1)))
        start = F.struct(F.lit(0).alias("at"), F.lit(0.0).cast("double").alias("h"))
        runs = F.aggregate(ends, start, lambda s, e: F.struct(e.alias("at"), (s["h"] + (e - s["at"]) * F.log2((e - s["at"]).cast("double"))).alias("h")))
        n = F.size(chars).cast("double")
        return F.when(n > 0, F.log2(n) - runs["h"] / n).otherwise(0.0)

    return let(F.array_sort(F.filter(F.split(c, ""), lambda x: x != "")), bits)


def html_text(c: Column) -> Column:
    """Text of HTML: scripts and styles dropped, tags to blanks, common entities decoded, white space collapsed."""
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return strip(F.regexp_replace(c, r"\s+", " "))
