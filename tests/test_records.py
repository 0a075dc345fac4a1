"""Rates of return, drawdown places, option spellings and accounts against plain Python."""

import pytest

from quantloom.functions import scalar as sc
from quantloom.operators import backtest as bt
from quantloom.operators import quant as qt
from pyspark.sql import functions as F


def test_irr(spark):
    rows = [("a", 0, -100.0), ("a", 1, 60.0), ("a", 2, 60.0), ("b", 0, 5.0), ("b", 1, 5.0), ("c", 0, 50.0), ("c", 1, -20.0), ("c", 2, -45.0), ("d", 0, None)]
    got = {r.k: r.rate for r in qt.irr(spark.createDataFrame(rows, "k string, i int, v double"), "k", "i", "v").collect()}
    assert got["b"] is None and "d" not in got
    for k, xs in {"a": [-100, 60, 60], "c": [50, -20, -45]}.items():
        assert abs(sum(x / (1 + got[k]) ** i for i, x in enumerate(xs))) < 1e-6


def test_drawdown_location(spark):
    xs = [10.0, 12.0, 12.0, 9.0, 12.0, 6.0, 13.0, 6.5]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)] + [("flat", 0, 1.0), ("flat", 1, 2.0)], "k string, i int, v double")
    got = {r.k: (r.mdd, r.duration, r.peak, r.trough) for r in qt.drawdown_location(df, "k", "i", "v").collect()}
    assert got == {"a": (0.5, 4, 1, 5), "flat": (0.0, 0, 0, 0)}


def test_option_type(spark):
    df = spark.createDataFrame([(" C ",), ("PUT",)], "x string")
    assert [r[0] for r in df.select(qt.option_type(F.col("x"))).collect()] == ["call", "put"]
    with pytest.raises(Exception, match="no option type"):
        spark.createDataFrame([("straddle",)], "x string").select(qt.option_type(F.col("x"))).collect()


def test_ledger(spark):
    rows = [("a", 1, True, 100, 10_0000, 0), ("a", 2, True, 50, 13_0000, 0), ("a", 3, False, 200, 20_0000, 0), ("a", 4, False, 120, 12_0000, 10_000_000), ("a", 5, True, 1000, 10_0000, 0), ("a", 6, False, 30, 5_0000, 0), ("b", 1, False, 1, 1, 0)]
    df = spark.createDataFrame(rows, "k string, i int, buy boolean, qty long, price long, fee long")
    got = {r.k: r for r in bt.ledger(df, "k", ["i"], 200_000).collect()}
    a = got["a"]
    assert (a.held, a.cost, a.filled, a.refused) == (0, 0, 4, 2)
    assert a.cash == (200_000 - 100_000 - 65_000 + 144_000 - 1 + 15_000) * 10_000_000
    assert a.pnl == (12 - 11) * 120 * 100 + (5 - 11) * 30 * 100
    assert (got["b"].cash, got["b"].refused) == (200_000 * 10_000_000, 1)


def test_times_and_prices(spark):
    df = spark.createDataFrame([("2024-03-01T10:00:00Z",), ("soon",), (None,)], "x string")
    got = [r[0] for r in df.select(sc.parsed_time(F.col("x"), F.lit("1999-01-01").cast("timestamp")).cast("string")).collect()]
    assert got == ["2024-03-01 10:00:00", "1999-01-01 00:00:00", None]
    texts = [("现价 10 上涨 5%", "buy"), ("现价 10 上涨 5%", "sell"), ("股价 10", "sell"), ("股价 10", "hold"), ("nothing", "buy")]
    df = spark.createDataFrame(texts, "x string, a string")
    assert [r[0] for r in df.select(sc.guessed_price(F.col("x"), F.col("a"))).collect()] == [10.5, 9.5, 9.5, 10.0, None]
