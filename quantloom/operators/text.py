"""Relevance, urgency and sentiment of short texts, deduplication by title, full-text scores and nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relevance(title: Column, body: Column, company: str, code: str, strong: list[str], include: list[str], exclude: list[str]) -> Column:
    """Additive: company 50/25, code 40/20, strong words 30/15, included 15/8, excluded -40/-20 (title/body, once each list);
    30 less if the title has an excluded word without the company; 0 to 100."""
    t, b = F.lower(title), F.lower(body)
    points = lambda hit, other, a, c: F.when(hit, a).when(other, c).otherwise(0)
    has = lambda x, words: F.coalesce(_any(x, words), F.lit(False))
    score = points(has(t, [company]), has(b, [company]), 50, 25) + points(has(t, [code]), has(b, [code]), 40, 20)
    score = score + points(has(t, strong), has(b, strong), 30, 15) + points(has(t, include), has(b, include), 15, 8)
    score = score + points(has(t, exclude), has(b, exclude), -40, -20) + F.when(has(t, exclude) & ~has(t, [company]), -30).otherwise(0)
    return F.least(F.greatest(score, F.lit(0)), F.lit(100))


def _any(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w.lower())
    return out


def urgency(text: Column, high: list[str], medium: list[str]) -> Column:
    t = F.lower(text)
    return F.when(_any(t, high), "high").when(_any(t, medium), "medium").otherwise("low")


def title_relevance(title: Column, ticker: str, aliases: list[str]) -> Column:
    """1.0 for the ticker, .8 for an alias, .9 for its digits, else .3, in this order."""
    digits = "".join(c for c in ticker if c.isdigit())
    out = F.when(F.lower(title).contains(ticker.lower()), 1.0).when(_any(F.lower(title), aliases), 0.8)
    return (out.when(title.contains(digits), 0.9) if digits else out).otherwise(0.3)


def dedup_titles(df: DataFrame, title: str, order: list[Column], newest: list[Column], n: int, least: int = 10) -> DataFrame:
    """One row for each lower-cased, trimmed title of over ``least`` characters, first in ``order``; then the newest ``n``."""
    t = df.withColumn("__k", F.lower(F.trim(F.col(title)))).where(F.length("__k") > least)
    t = t.withColumn("__rn", F.row_number().over(Window.partitionBy("__k").orderBy(*order))).where("__rn = 1")
    return t.drop("__k", "__rn").orderBy(*newest).limit(n)


def full_text(text: Column, query: list[str]) -> Column:
    """How many of the words of the query stand in the text."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.size(F.array_intersect(words, F.array(*[F.lit(q.lower()) for q in query])))


def lexicon_sentiment(text: Column, good: list[str], bad: list[str]) -> Column:
    """(good - bad) / (good + bad) over the words that stand in the text, each once; 0 if none does."""
    count = lambda words: sum((F.when(F.lower(text).contains(w), 1).otherwise(0) for w in words), F.lit(0))
    a, b = count(good), count(bad)
    return F.coalesce(F.try_divide((a - b).cast("double"), (a + b).cast("double")), F.lit(0.0))


def band(score: Column) -> Column:
    return F.when(score > 0.3, "very_positive").when(score > 0.1, "positive").when(score < -0.3, "very_negative").when(score < -0.1, "negative").otherwise("neutral")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(df: DataFrame, vector: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to ``vector`` by squared distance with ``similarity`` = 1 - distance; none for a zero vector."""
    if not any(vector):
        return df.select(key).withColumn("similarity", F.lit(0.0)).limit(0)
    q = F.array(*[F.lit(float(v)) for v in vector])
    return df.select(key, (1 - squared_distance(F.col(column), q)).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)
