"""State machines, streams and files on small fixtures with results worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import folds
from quantloom.operators import backtest as bt
from quantloom.operators import panel, quant, relational, screen
from quantloom.sources import files
from quantloom.streaming import snapshots

SF = "/root/testdata/sf0.001"


def test_account_buys_whole_lots_next_open_and_closes_at_the_end():
    o, c = np.array([10.0, 10.0, 11.0]), np.array([10.0, 10.5, 11.0])
    equity, profits = bt.account(o, c, np.array([1, 0, 0]), 10_000.0)
    held = 900  # ten lots and the fee don't fit
    cost = held * 10 + 5
    end = held * 11 - (5 + held * 11 * 0.0005)
    assert profits == [pytest.approx(end - cost)]
    assert equity[-1] == pytest.approx(10_000 - cost + end)


def test_account_drops_orders_beyond_the_limit():
    equity, profits = bt.account(np.array([10.0, 11.5, 11.0]), np.array([10.0, 11.0, 11.0]), np.array([1, 0, 0]), 10_000.0)
    assert profits == [] and equity[-1] == 10_000


def test_seeded_ema_and_wilder():
    x = np.array([1.0, 2.0, 3.0, 4.0, math.nan, 5.0])
    assert np.allclose(folds.ema_seeded(x, 3)[2:], [2, 3, 3, 4])
    assert np.isnan(folds.ema_seeded(x, 3)[:2]).all()
    assert np.allclose(folds.rsi_wilder(np.array([1.0, 2, 3, 4]), 2)[2:], [100, 100])


def test_sar_reverses():
    high, low = np.array([10.0, 11, 12, 13, 9, 8]), np.array([9.0, 10, 11, 12, 7, 6])
    out = folds.sar(high, low)
    assert np.isnan(out[0]) and out[1] == 9 and out[3] < 12 and out[4] == 13  # the extreme becomes the stop


def test_dmi_of_a_steady_rise_is_one_sided():
    n = 60
    out = folds.dmi(np.arange(n) + 1.0, np.arange(n) + 0.0, np.arange(n) + 0.5)
    assert out["mdi"][-1] == 0 and out["adx"][-1] == pytest.approx(100)


def test_decay_weighs_the_oldest_most(spark):
    df = spark.createDataFrame([("a", f"2024-01-0{i}", float(i)) for i in (1, 2, 3)], "symbol string, trade_date string, close double")
    got = df.select(panel.decay_linear(F.col("close"), 3).alias("v")).collect()
    assert got[-1].v == pytest.approx(10 / 6) and got[0].v is None


def test_flat_and_tree_treat_null_apart(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, 4.0)], "code int, pe double")
    flat = df.where(screen.flat([{"field": "pe", "operator": "!=", "value": 3.0}], {"pe"}))
    tree = df.where(screen.tree({"field": "pe", "op": "!=", "value": 3.0}, {"pe"}))
    assert [r.code for r in flat.collect()] == [1, 3] and [r.code for r in tree.collect()] == [3]
    assert screen.validate([{"field": "x", "operator": "=="}, {"field": "pe", "operator": "between", "value": 3}], {"pe": "number"}) == ["0: no field 'x'", "1: between takes two values"]
    assert screen.fields_of({"children": [{"field": "a", "op": ">", "right_field": "b"}, {"field": "a", "op": ">", "value": 1}]}) == ["a", "b"]


def test_options_against_published_values(spark):
    df = spark.createDataFrame([(100.0, 100.0, 1.0, 0.05, 0.2, True), (100.0, 100.0, 1.0, 0.05, 0.2, False), (110.0, 100.0, 0.0, 0.05, 0.2, True)], "s double, k double, t double, r double, v double, call boolean")
    call, put, done = quant.option_values(df).collect()
    assert call.price == pytest.approx(10.450583572185565, abs=1e-9) and put.price == pytest.approx(5.573526022256971, abs=1e-9)
    assert call.price - put.price == pytest.approx(100 - 100 * math.exp(-0.05), abs=1e-9)
    assert call.iv == pytest.approx(0.2, abs=1e-6) and done.price == 10 and done.iv is None


def test_xirr_of_a_year(spark):
    df = spark.createDataFrame([("a", "2023-01-01", -100.0), ("a", "2024-01-01", 110.0), ("b", "2023-01-01", 5.0)], "k string, d string, a double").withColumn("d", F.to_date("d"))
    got = {r.k: r.rate for r in quant.xirr(df, "k", "d", "a").collect()}
    assert got["a"] == pytest.approx(0.10, abs=1e-9) and got["b"] is None


def test_streams_equal_their_batches(spark, tmp_path):
    events = snapshots.read_events(spark, SF)
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, make in (("tumbling", snapshots.tumbling), ("sessions", snapshots.sessions)):
        got = snapshots.drain(make(events), f"t_{name}")
        want = make(batch)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    q = snapshots.snapshot(events, str(tmp_path / "snap"), ["user_id"], "ts", str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "snap" / "generation=0")).count() == batch.select("user_id").distinct().count()


def test_lines_parse_in_three_forms(spark):
    df = spark.createDataFrame([("a,1",), ("b\t2",), ("c  3",)], "x string").select(files.parse_line(F.col("x"), "k string, v int").alias("p"))
    assert [(r.p.k, r.p.v) for r in df.collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_cached_stage_is_made_once(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert files.cached(spark, str(tmp_path), "k", make).count() == files.cached(spark, str(tmp_path), "k", make).count() == 3 and len(made) == 1


def test_flat_conditions_reach_the_scan(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    keep = screen.flat([{"field": "c_acctbal", "operator": "between", "value": [0, 5000]}, {"field": "c_mktsegment", "operator": "in", "value": ["BUILDING", "MACHINERY"]}], set(t.columns))
    plan = t.where(keep)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "PushedFilters: []" not in plan and "In(" in pushed  # Spark cuts the list off


def test_crosses_and_malformed_conditions_are_false(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0)], "symbol string, trade_date int, close double")
    for x in ({"field": "close", "op": "cross_up", "value": 2.0}, {"field": "close", "op": "between", "value": 3}, {"field": "close", "op": "like", "value": 3}):
        assert df.where(screen.tree(x, set(df.columns))).count() == 0


def test_global_ranks_equal_pandas(spark):
    import random

    rng = random.Random(3)
    xs = [None if rng.random() < 0.1 else float(rng.choice([rng.randrange(5), rng.randrange(2000)])) for _ in range(1500)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double")
    t = relational.global_ranks(df, "x")
    got = t.select("k", relational.percentile(t, "x", True).alias("last"), relational.percentile(t, "x", False).alias("first")).toPandas().set_index("k").sort_index()
    s = df.toPandas().set_index("k").x
    for name, option in (("last", "bottom"), ("first", "top")):
        want = s.rank(method="average", na_option=option, pct=True)
        assert ((got[name] - want).abs() < 1e-12).all()
    assert relational.global_ranks(df.limit(0), "x").count() == 0
