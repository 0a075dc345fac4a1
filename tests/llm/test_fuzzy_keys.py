"""A line's SimHash is the majority of its words' bits, in lanes of either width; the words that one line alone has bound the distance."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.llm import fuzzy_lines as fl

MASK = (1 << 64) - 1


def lines(rng):
    words = [f"w{k}" for k in range(400)]
    return [rng.sample(words, n) + ["w0"] * (n % 3) for n in (1, 2, 5, 6, 8, 13, 40, 90, 253, 254, 255, 256, 257, 300) for _ in range(3)]


def by_hand(spark, rows):
    df = spark.createDataFrame([(k, " ".join(a)) for k, a in enumerate(rows)], "lid long, norm string")
    words = df.select(F.explode(F.split("norm", " ")).alias("w")).distinct()
    h = {r.w: r.h & MASK for r in words.select("w", F.xxhash64(F.lit(2), "w").alias("h")).collect()}
    bags = [set(a) for a in rows]
    return df, {k: (sum(1 << j for j in range(62) if 2 * sum(h[w] >> j & 1 for w in bag) > len(bag)), len(rows[k])) for k, bag in enumerate(bags)}


def test_simhash_is_the_majority_of_bits_at_any_length(spark):
    df, want = by_hand(spark, lines(random.Random(4)))
    assert {r.lid: (r.sim, r.n) for r in fl.simhash(df).collect()} == want


@pytest.mark.parametrize("width", [fl.NARROW, 31])
def test_lanes_count_alike_at_either_width(spark, width):
    df, want = by_hand(spark, [a for a in lines(random.Random(5)) if len(set(a)) < 1 << (fl.NARROW - 1)])
    words = df.select("lid", F.split("norm", " ").alias("w")).select("lid", F.size("w").alias("n"), F.explode(F.array_distinct("w")).alias("w"))
    got = fl._majorities(words.select("lid", "n", F.xxhash64(F.lit(2), "w").alias("h")), width)
    assert {r.lid: (r.sim, r.n) for r in got.collect()} == want
