"""Queries that SQL can't express, held by what their results must satisfy, and backtests against a plain account."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import folds
from quantloom.operators import backtest as bt
from quantloom.operators import indicators as ind
from quantloom.plans import catalog
from quantloom.sources.bars import weekly_brand_bars

SF = "/root/testdata/sf0.001"


def test_flows_are_worth_nothing_at_their_rate(spark):
    t = spark.read.parquet(f"{SF}/orders.parquet")
    flows = t.groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))).alias("a"))
    own = {}
    for r in flows.collect():
        own.setdefault(r.o_custkey, []).append((r.d, r.a))
    rates = {r.code: r.rate for r in catalog.QUERIES["q_xirr"](spark, SF).collect()}
    assert rates.keys() == own.keys()
    found = 0
    for code, fs in own.items():
        first = min(d for d, _ in fs)
        worth = lambda r, fs=fs, first=first: sum(a / (1 + r) ** ((d - first).days / 365) for d, a in fs)
        signs = {a > 0 for _, a in fs}
        if rates[code] is None:
            # No change of sign over the searched rates.
            assert len(signs) < 2 or worth(-0.9999) * worth(1e6) > 0 or not math.isfinite(worth(-0.9999))
        else:
            found += 1
            assert len(signs) == 2 and abs(worth(rates[code])) <= 1e-6 * sum(abs(a) for _, a in fs)
    assert found > 20


def test_options_obey_parity_and_give_their_volatility_back(spark):
    rows = catalog.QUERIES["q_options"](spark, SF).collect()
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    for r in rows:
        d1 = (math.log(r.s / r.k) + (r.r + r.v**2 / 2) * r.t) / (r.v * math.sqrt(r.t))
        d2 = d1 - r.v * math.sqrt(r.t)
        call = r.s * cdf(d1) - r.k * math.exp(-r.r * r.t) * cdf(d2)
        want = call if r.call else call - r.s + r.k * math.exp(-r.r * r.t)
        assert r.price == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert r.delta == pytest.approx(cdf(d1) - (0 if r.call else 1), abs=1e-12)
        assert r.iv is None or r.iv == pytest.approx(r.v, abs=1e-6)
    assert sum(r.iv is not None for r in rows) > 0.9 * len(rows)


def plain_account(opens, closes, signals, capital, first):
    """The market's rules, one step at a time: fills at the next open, limits, whole lots, fees, no sale on the day of the purchase."""
    cash, shares, day, cost, wins, trips, values, order = capital, 0, None, 0.0, 0, 0, [], None
    buy_fee = lambda a: max(a * 0.00025, 5.0)
    for i, (o, c) in enumerate(zip(opens, closes)):
        change = o / closes[i - 1] - 1 if i else 0.0
        if (order == "buy" and change < 0.1 - 1e-6) or (first and i == 0):
            n = int(cash // (o * 100)) * 100
            while n and n * o + buy_fee(n * o) > cash + 1e-9:
                n -= 100
            if n:
                shares, day, cost = n, i, n * o + buy_fee(n * o)
                cash -= cost
        elif order == "sell" and change > -0.1 + 1e-6:
            got = shares * o - buy_fee(shares * o) - shares * o * 0.0005
            cash, wins, trips, shares = cash + got, wins + (got > cost), trips + 1, 0
        order = "buy" if signals[i] > 0 and not shares else "sell" if signals[i] < 0 and shares else None
        values.append(round(cash + shares * c, 2))
    if shares and day != len(closes) - 1:
        got = shares * closes[-1] - buy_fee(shares * closes[-1]) - shares * closes[-1] * 0.0005
        cash, wins, trips = cash + got, wins + (got > cost), trips + 1
        values[-1] = round(cash, 2)
    return values, wins, trips


@pytest.mark.parametrize("strategy", ["buy_hold", "ma_cross", "momentum", "rsi_reverse"])
def test_backtests_equal_a_plain_account(spark, strategy):
    bars = weekly_brand_bars(spark, SF)
    got = {r.symbol: r for r in catalog.QUERIES[f"bt_run_{strategy}"](spark, SF).collect()}
    own = {}
    for r in bt.with_signals(bars, strategy).select("symbol", "trade_date", "open", "close", "signal").orderBy("symbol", "trade_date").collect():
        own.setdefault(r.symbol, []).append(r)
    assert got.keys() == own.keys()
    for s, rows in own.items():
        signals = [0 if strategy == "buy_hold" else r.signal for r in rows]
        values, wins, trips = plain_account([r.open for r in rows], [r.close for r in rows], signals, 1_000_000.0, strategy == "buy_hold")
        r = got[s]
        assert r.final == pytest.approx(values[-1]) and r.n_trades == trips and (r.win_rate is None if not trips else r.win_rate == pytest.approx(wins / trips, abs=1e-6))
        top, fall = 0.0, 0.0
        for v in values:
            top = max(top, v)
            fall = max(fall, (top - v) / top)
        assert r.mdd == pytest.approx(fall, abs=1e-6)


def test_signals_of_the_rsi_equal_its_loop(spark):
    own = {}
    for r in bt.with_signals(weekly_brand_bars(spark, SF), "rsi_reverse").select("symbol", "trade_date", "close", "signal").orderBy("symbol", "trade_date").collect():
        own.setdefault(r.symbol, []).append(r)
    for rows in own.values():
        rsi = folds.rsi_wilder(np.array([r.close for r in rows]), 14)
        assert [r.signal for r in rows] == [1 if x < 30 else -1 if x > 70 else 0 for x in rsi]


def test_directional_movement_equals_its_loop(spark):
    bars = weekly_brand_bars(spark, SF)
    got, rows = {}, {}
    for r in ind.a_dmi(bars).orderBy("symbol", "trade_date").collect():
        got.setdefault(r.symbol, []).append([math.nan if x is None else x for x in (r.pdi, r.mdi, r.adx, r.adxr)])
    for r in bars.orderBy("symbol", "trade_date").collect():
        rows.setdefault(r.symbol, []).append((r.high, r.low, r.close))
    for s, xs in rows.items():
        want = folds.dmi(*np.array(xs).T)
        np.testing.assert_allclose(np.array(got[s]).T, np.array([want[k] for k in ("pdi", "mdi", "adx", "adxr")]), rtol=1e-9)
