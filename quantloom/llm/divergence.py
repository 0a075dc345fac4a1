"""Quality rules by distribution divergence, with DataFrame functions alone.

Each text gives two histograms: its characters by class (CLASSES) and its words by the common words of its language
(and all others). A language's reference is the sum of those histograms over its documents: first over all, then,
so that junk doesn't blur it, over those of at least REFINE_WORDS words that lie near the first (over all again if
there are none). A text is rejected if
the Jensen-Shannon distance (base 2, 0 to 1) of either histogram to its language's reference exceeds a limit. What a
short text draws strays by chance, so each limit allows for the sampling noise, which falls as one over the root of
the number drawn, and texts of fewer than MIN_CHARS characters or MIN_WORDS words aren't judged by that histogram.

Languages are those of COMMON; any other, or null, is judged by the reference of all such texts together ("other"),
on the common words of all languages.

Base rules: fewer than 50 words, or over half of the words in three-word windows that come up twice. Windows are
compared by sorting pairs of their 64-bit hash and position in the row; neighbours of equal hash are confirmed by their words.

Nulls: a null text counts as empty: all counts 0, base_failed, not kept. A null doc_id or lang is allowed; repeated
rows are repeated; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, clean_columns, staged, table

#: The commonest function words of each language.
COMMON = {
    "de": "der die das und in zu den mit von für auf ist im nicht ein eine einen des dem als auch sich es an".split(),
    "en": "the of and to in a is that it for on with as was by this be are from or an at not have".split(),
    "es": "el la los las de y en que un una por con para se del al es lo como más no su sus o".split(),
    "fr": "le la les de des et un une du en que qui dans pour par sur avec est au aux pas plus ce il".split(),
}
OTHER = "other"
CLASSES = ["space", "symbol", "stop", "digit", "capital", "rest"]
SYMBOLS, STOPS, DIGITS, WHITE = "#*$%&|<>", ".,;:!?", "0123456789", " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_WORDS = 200, 100
#: Words and most distance, by characters and by words, of the texts that the refined references sum.
REFINE_WORDS, REFINE_CHARS, REFINE = 200, 0.25, 0.22
#: Limit and allowance for noise: distance > limit + noise / sqrt(number drawn).
CHAR_LIMIT, CHAR_NOISE, WORD_LIMIT, WORD_NOISE = 0.125, 1.1, 0.22, 2.5


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _covered(at: Column, window: int) -> Column:
    """Words that the windows at these positions cover."""
    at = F.array_sort(F.array_distinct(at))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
    step = lambda s, i: F.struct((s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"), i.alias("last"))
    return F.aggregate(at, zero, step, lambda s: s["n"])


def features(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, the base columns, and the two histograms ``chars`` and ``words``."""
    t = clean_columns(docs, "doc_id", "lang", "text").withColumn("text", F.coalesce("text", F.lit("")))
    t = t.withColumn("lang", F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(F.lit(OTHER)))
    bare = F.expr(f"trim(BOTH '{WHITE}' FROM text)".replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\x0b", "\\u000B").replace("\x0c", "\\u000C"))
    t = t.withColumn("w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))
    dense = _without(F.col("text"), WHITE)
    plain = _without(F.col("dense"), SYMBOLS)
    still = _without(F.col("plain"), STOPS)
    t = t.withColumn("dense", dense).withColumn("plain", plain).withColumn("still", still)
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    t = t.withColumn("lines", lines).withColumn("letters", _without(F.col("still"), DIGITS))
    lists = F.create_map(*[x for k, v in [*COMMON.items(), (OTHER, sorted({w for v in COMMON.values() for w in v}))] for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for v in COMMON.values() for w in v})
    t = t.withColumn("common", F.filter("w", lambda x: x.isin(*every))).withColumn("list", lists[F.col("lang")])
    n = F.size("w")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    t = t.select(
        "doc_id", "lang", "w", "common", "list",
        n.cast("long").alias("n_words"),
        F.length("dense").cast("long").alias("word_chars"),
        (F.length("dense") - F.length("plain")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array(*[x.cast("double") for x in (F.length("text") - F.length("dense"), F.length("dense") - F.length("plain"), F.length("plain") - F.length("still"), F.length("still") - F.length("letters"), F.length("letters") - F.length(F.regexp_replace("letters", r"\p{Lu}+", "")), F.length(F.regexp_replace("letters", r"\p{Lu}+", "")))]).alias("chars"),
        F.coalesce(hashes, F.array().cast("array<bigint>")).alias("h"),
    )
    t = t.withColumn("s", F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    same_words = lambda a, b: (F.get("w", a) == F.get("w", b)) & (F.get("w", a + 1) == F.get("w", b + 1)) & (F.get("w", a + 2) == F.get("w", b + 2))
    spot = lambda j: F.get("s", j)["i"]
    near = F.filter(F.sequence(F.lit(1), F.size("s") - 1), lambda j: (F.get("s", j)["h"] == F.get("s", j - 1)["h"]) & same_words(spot(j), spot(j - 1)))
    t = t.withColumn("near", F.when(F.size("s") >= 2, near).otherwise(F.array().cast("array<int>")))
    t = t.withColumn("twice", F.concat(F.transform("near", spot), F.transform("near", lambda j: spot(j - 1))))
    counts = F.transform("list", lambda x: (F.size("common") - F.size(F.array_remove("common", x))).cast("double"))
    t = t.withColumn("counts", counts)
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    return t.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("twice"), 3).cast("long").alias("n_repeat_words"), "chars", F.concat("counts", F.array(F.col("n_words") - total)).alias("words"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms, each scaled to sum to 1; null if either is empty."""
    scale = lambda x: F.transform(x, lambda v: F.try_divide(v, F.aggregate(x, F.lit(0.0), lambda a, y: a + y)))
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(scale(p), scale(q), lambda a, b: part(a, b) + part(b, a))
    some = F.exists(p, lambda x: x > 0) & F.exists(q, lambda x: x > 0)
    return F.when(some, F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0))))


def references(rows: DataFrame) -> DataFrame:
    """``lang``, ``ref_chars`` and ``ref_words``: one row for each language of COMMON and for the others, so five at most."""
    longest = 1 + len({w for v in COMMON.values() for w in v})
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(longest)]
    t = rows.groupBy("lang").agg(*sums)
    words = F.filter(F.array(*[F.col(f"w{i}") for i in range(longest)]), lambda x: x.isNotNull())
    return t.select("lang", F.array(*[F.col(f"c{i}") for i in range(len(CLASSES))]).alias("ref_chars"), words.alias("ref_words"))


def _measured(rows: DataFrame, refs: DataFrame) -> DataFrame:
    t = rows.join(F.broadcast(refs), "lang")
    t = t.withColumn("char_distance", distance(F.col("chars"), F.col("ref_chars"))).withColumn("word_distance", distance(F.col("words"), F.col("ref_words")))
    return t.drop("ref_chars", "ref_words")


def judged(docs: DataFrame) -> DataFrame:
    """The base columns, ``char_distance``, ``word_distance``, ``base_failed`` and ``kept`` of each row."""
    rows = staged(features(docs), "divergence")
    first = references(rows)
    near = _measured(rows, first).where((F.col("n_words") >= REFINE_WORDS) & (F.col("char_distance") <= REFINE_CHARS) & (F.col("word_distance") <= REFINE))
    second = references(near).select("lang", F.col("ref_chars").alias("c2"), F.col("ref_words").alias("w2"))
    refs = first.join(F.broadcast(second), "lang", "left").select("lang", F.coalesce("c2", "ref_chars").alias("ref_chars"), F.coalesce("w2", "ref_words").alias("ref_words"))
    t = _measured(rows, staged(refs, "divergence-references"))
    drawn = F.aggregate("chars", F.lit(0.0), lambda a, x: a + x)
    odd_chars = (drawn >= MIN_CHARS) & (F.col("char_distance") > CHAR_LIMIT + F.lit(CHAR_NOISE) / F.sqrt(drawn))
    odd_words = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > WORD_LIMIT + F.lit(WORD_NOISE) / F.sqrt(F.col("n_words")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    t = t.withColumn("base_failed", failed)
    odd = F.coalesce(odd_chars, F.lit(False)) | F.coalesce(odd_words, F.lit(False))
    return t.withColumn("kept", ~F.col("base_failed") & ~odd).drop("chars", "words")


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
