"""Order statistics by counts and slices against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import relational as rel

PERCENTS = {"lo": 0, "p25": 25, "mid": 50, "p75": 75, "p99": 99, "hi": 100}


def by_hand(values):
    xs = sorted(values)
    return tuple(xs[int(p / 100 * (len(xs) - 1))] for p in PERCENTS.values())


@pytest.mark.parametrize("spread", [3, 50, 10**6])
def test_places_of_many_ties_and_of_few(spark, spread):
    rng = random.Random(spread)
    rows = [("hot", float(rng.randrange(spread))) for _ in range(5000)] + [("one", 7.0), ("two", 1.0), ("two", -1.0), (None, 4.0), (None, 4.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: tuple(r[p] for p in PERCENTS) for r in rel.order_statistics(df, "k", "x", PERCENTS).collect()}
    values = {}
    for k, x in rows:
        if x is not None and k is not None:
            values.setdefault(k, []).append(x)
    assert got == {k: by_hand(xs) for k, xs in values.items()}


def test_no_list_of_values_in_the_plan(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    text = rel.order_statistics(df, "k", "x", {"p": 30})._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(x" not in text and "collect_list(__v" not in text
    assert rel.order_statistics(df.limit(0), "k", "x", {"p": 30}).count() == 0
