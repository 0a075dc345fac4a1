"""Spelling variants: words one edit apart, grouped under the form that most texts use, by a symmetric-delete join.

Every word emits itself and its distinct single deletions. Two words one edit apart share exactly one of these keys:
the shorter word itself where a letter is missing, or what both leave without the letter that differs. An equi-join on
the keys finds them; the places at which a deletion can have been taken decide inside the join which words of a key are
candidates, and an exact distance of one confirms them. A word's form is its most frequent near word, if that is
frequent enough beside it; words follow their forms to a root by doubling pointers.

A key of L letters is shared by at most (L + 1) * 90 words and itself, since words are made of 90 letters (a to z and
U+00C0 to U+00FF), however many documents there are: no key grows with the corpus. Occurrences are counted before
anything is joined, so a frequent word is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, clean_columns, drop_stage, staged, table

RUNS = r"([A-Za-zÀ-ÿ]+)"
#: One occurrence in so many loses a letter, chosen by a checksum of document and word.
ONE_IN = 199
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: Pointers double each round; a form is RATIO times as frequent as its word, so paths are short.
MAX_ROUNDS = 40


def _without(word: Column, place: Column) -> Column:
    """``word`` without its letter at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word)))


def occurrences(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """``word``: one row for each run of letters, lower-cased, one in ``one_in`` of them without a letter.

    A null text has no runs; a null id counts as an empty one in the checksum. Other columns are ignored.
    """
    runs = clean_columns(docs, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUNS), 1)).alias("run"))
    runs = runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    cut = _without(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))
    return runs.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def frequent(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: distinct words of enough letters and occurrences. Null words don't count."""
    counts = words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def deletions(words: DataFrame) -> DataFrame:
    """``key, word, n, first, last``: each word under its own hash (``first`` null) and under those of its distinct deletions.

    Letters of a run of equal ones leave the same word, so a deletion has the places of one run. Keys are hashes: a long
    word's deletions aren't held side by side, and the exact distance sorts out chance matches.
    """
    w = F.col("word")
    size = F.char_length(w)
    # A place starts a run if its letter isn't the one before.
    places = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.substring(w, i + 1, F.lit(1)) != F.substring(w, i, F.lit(1))))
    starts = words.where(size > 0).select("word", "n", places.alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(size))
    cut = F.transform("starts", lambda first, k: F.struct(F.xxhash64(_without(w, first)).alias("key"), first.alias("first"), (F.get(ends, k) - 1).alias("last")))
    itself = F.struct(F.xxhash64(w).alias("key"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    rows = starts.select("word", "n", F.explode(F.concat(F.array(itself), cut)).alias("e"))
    return rows.select("e.key", "word", "n", "e.first", "e.last")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: both directions of every pair of words exactly one edit apart, once each."""
    keys = deletions(words)
    a = keys.select("key", *[F.col(c).alias(f"a_{c}") for c in keys.columns if c != "key"])
    b = keys.select("key", *[F.col(c).alias(f"b_{c}") for c in keys.columns if c != "key"])
    inserted = F.col("a_first").isNull() != F.col("b_first").isNull()
    replaced = (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))
    pairs = a.join(b, "key").where((inserted | replaced) & (F.col("a_word") != F.col("b_word")))
    pairs = pairs.where(F.levenshtein("a_word", "b_word", 1) == 1)
    # A pair shares one key; only a chance match of hashes could bring it twice.
    return pairs.groupBy(F.col("a_word").alias("word"), F.col("b_word").alias("near")).agg(F.first("a_n").alias("n"), F.first("b_n").alias("near_n"))


def forms(words: DataFrame, near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n``: ``form`` is the near word of largest count (the smallest of ties), if that is ``ratio`` times the word's or more."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    got = words.join(best, "word", "left")
    enough = -F.col("b.m") >= ratio * F.col("n")
    return got.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("b.w")).alias("form"), F.when(enough, -F.col("b.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``word, root``: where a word's forms end. Each round joins the pointers with themselves, until none moves."""
    at = staged(formed.select("word", F.coalesce("form", "word").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    for _ in range(MAX_ROUNDS):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = at.join(onward, "root").select("word", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved"))
        last, at = at, staged(step, "spelling-roots")
        drop_stage(last)
        if at.where("moved").isEmpty():
            return at
    raise RuntimeError("forms didn't end")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every frequent word of ``docs`` (doc_id, text).

    Empty tables and texts without letters give no rows. Repeated rows count as often as they stand. Ties go to the
    smallest word in code-point order. Further columns of ``docs`` are ignored, whatever their names.
    """
    words = staged(frequent(occurrences(docs)), "spelling-words")
    formed = staged(forms(words, near_words(words)), "spelling-forms")
    return formed.join(roots(formed).select("word", "root"), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op11_symmetric_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
