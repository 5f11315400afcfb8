"""Grouping of spelling variants by a symmetric-delete join (operator 12).

Two words are near if one inserted, deleted or replaced letter makes one of the other.  Every word emits itself and its
distinct single deletions as keys; words at distance one always share a key, and exactly one of them: the shorter word
itself, or what both have without the letter that differs.  So one equi-join finds every pair once, and an exact distance
check leaves the true ones.  A word's form is its most frequent near word, where that is frequent enough; roots follow
forms by repeated self-joins, each of which doubles the way covered.

Keys are 64-bit hashes, made for a batch of words at a time from running sums over their letters, so a word's
deletions cost as many steps as it has letters, however long it is; what two words share by chance fails the distance check.
Pairs travel as ids of words and meet the words only for that check.  Counting is done in Spark's own expressions with
partial sums before any shuffle, so a word that makes up a third of the corpus is no hot key.  A key is shared by at most as many words
as there are letters times places to insert one, whatever the size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import _words
from docloom.llm._spark import Workspace, long, map_batches

#: Fixed value: runs of Latin letters.
RUNS = r"[A-Za-zÀ-ÿ]+"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``run``) for every maximal run of letters of every text, A-Z lower-cased and no other letter; null texts have none."""
    low = F.translate(F.col(text_col), *_LOWER)
    return docs.select(F.col(id_col), F.explode(F.regexp_extract_all(low, F.lit(RUNS), F.lit(0))).alias("run"))


def count_words(words: DataFrame, word: str | Column = "run", min_letters: int = 6, min_count: int = 5) -> DataFrame:
    """(``word``, ``n``) of the words of at least ``min_letters`` code points that occur at least ``min_count`` times; nulls are no words."""
    return words.select((F.col(word) if isinstance(word, str) else word).alias("word")).where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keys(batch: pa.RecordBatch):
    """(id, key) of every word of a batch (id, word) and of its distinct single deletions."""
    letters = batch.column(1).cast(pa.large_string())
    size = pa.compute.utf8_length(letters).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(letters.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    first = ends - size
    place = np.arange(len(codes)) - first[word]
    # the hash of a word is the sum of mix(letter) * base^place; without letter i the later places move down by one
    longest = int(size.max(initial=0))
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(longest, _BASE, np.uint64), dtype=np.uint64)])
    terms = _words.mix(codes + np.uint64(1)) * powers[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    whole = sums[ends] - sums[first]
    before, after = sums[:-1] - sums[first][word], sums[ends][word] - sums[1:]
    distinct = (place == 0) | (codes != np.concatenate([np.zeros(1, np.uint64), codes[:-1]]))
    without = (before + after * _INVERSE)[distinct]
    lengths = np.concatenate([size, size[word][distinct] - 1]).astype(np.uint64)
    key = _words.mix(_words.mix(np.concatenate([whole, without])) + lengths)
    ids = pa.concat_arrays([batch.column(0), batch.column(0).take(pa.array(word[distinct]))])
    yield {"id": ids, "key": key.view(np.int64)}


def group_variants(counts: DataFrame, factor: int = 5, word_col: str = "word", count_col: str = "n") -> DataFrame:
    """One row per word of ``counts`` (word, count): ``word``, ``n``, ``n_near`` (its near words), ``form``, ``form_n``, ``root``.

    ``form`` is the near word of largest count (ties: smallest in code-point order) if that count is at least ``factor`` (2 or more)
    times the word's own, else null; ``root`` is what following forms ends at, the word itself without a form.

    Null words take no part and rows of the same word count as one (their sum); words of any length are compared whole; the empty word is near every
    word of one letter; an empty table gives an empty result; other columns are not read.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent than their words")
    work = Workspace(counts.sparkSession, "spelling")
    summed = counts.where(F.col(word_col).isNotNull()).groupBy(F.col(word_col).alias("word")).agg(F.sum(count_col).alias("n"))
    words = work.write(summed.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    keys = work.write(map_batches(words.select("id", "word"), [long("id"), long("key")], _keys), "keys")
    pairs = keys.alias("a").join(keys.alias("b"), "key").where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    met = pairs.join(words.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a")), "a")
    met = met.join(words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b")), "b")
    # a pair shares two keys only if one of them is chance, which is so rare that telling equal rows apart here costs little
    near = work.write(met.where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b", "word_a", "n_a", "word_b", "n_b").distinct(), "near")
    work.drop("keys")
    both = near.select(F.col("a").alias("id"), F.col("word_b").alias("other"), F.col("n_b").alias("m")).unionByName(
        near.select(F.col("b").alias("id"), F.col("word_a").alias("other"), F.col("n_a").alias("m"))
    )
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    told = words.join(both.groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best")), "id", "left")
    fits = -F.col("best.m") >= factor * F.col("n")
    formed = work.write(
        told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "formed"
    )
    work.drop("near", "words")
    return formed.join(_roots(work, formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(work: Workspace, formed: DataFrame) -> DataFrame:
    """(word, root) of every word with a form; counts rise by the factor from form to form, so ways are short and end."""
    now, step = work.write(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        after = work.write(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{step}")
        moved = after.where("moved").limit(1).count()
        work.drop(f"roots-{step - 1}")
        now = after.drop("moved")
        if not moved:
            return now
