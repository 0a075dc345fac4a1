"""User strategies, measures called from SQL text, and the momentum report on a made calendar."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from quantloom.functions import sql
from quantloom.operators import backtest as bt

DAYS = [date(2026, 5, 1) + timedelta(days=k) for k in range(60)]
BARS = "symbol string, trade_date date, open double, close double, note string"


def bars(spark, **closes):
    return spark.createDataFrame([(s, d, float(c), float(c), "x") for s, cs in closes.items() for d, c in zip(DAYS, cs)], BARS)


def test_a_users_strategy_keeps_its_own_state(spark):
    def every_third(t, i, state):
        state["seen"] = state.get("seen", 0) + 1
        assert state["symbol"] == t["symbol"].iloc[i] and state["seen"] == i + 1 and t["note"].iloc[i] == "x"
        return {0: "buy", 2: "sell"}.get(i % 4, "hold")

    rise = [10.0 + 0.1 * k for k in range(20)]
    df = bars(spark, a=rise, b=rise[::-1])
    got = {r.symbol: r for r in bt.run_backtest(df, every_third, 10_000.0).collect()}
    assert got["a"].n_trades == 5 and got["a"].win_rate == pytest.approx(1.0) and got["b"].win_rate == 0
    # A failing strategy holds.
    failing = {r.symbol: r.final for r in bt.run_backtest(df, lambda t, i, state: 1 / 0, 10_000.0).collect()}
    assert failing == {"a": 10_000.0, "b": 10_000.0}


def test_a_named_strategy_equals_the_same_as_a_function(spark):
    rng = np.random.default_rng(4)
    df = bars(spark, a=list(20 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))), b=list(50 * np.exp(np.cumsum(rng.normal(0, 0.01, 60)))))

    def momentum(t, i, state):
        return "hold" if i < 20 else "buy" if t["close"][i] > t["close"][i - 20] else "sell"

    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(bt.run_backtest(df, momentum).collect()) == key(bt.run_backtest(df, "momentum").collect())


def test_limits_stop_one_side_only():
    flat = np.array([10.0, 10.0, 10.0, 10.0])
    down = bt.account(np.array([10.0, 8.0, 10.0, 10.0]), flat, np.array([1, 0, 0, 0]), 10_000.0)  # a purchase far below the last close is filled
    assert down[1] == [pytest.approx(1200 * 10 - 5 - 6 - 1200 * 8 - 5)]
    up = bt.account(np.array([10.0, 11.0, 10.0, 10.0]), flat, np.array([1, 0, 0, 0]), 10_000.0)
    assert up[1] == []
    stuck = bt.account(np.array([10.0, 10.0, 8.9, 10.0]), flat, np.array([1, -1, 0, 0]), 10_000.0)  # no sale at the lower limit; the last close sells
    assert len(stuck[1]) == 1
    first = bt.account(flat, flat, np.zeros(4), 10_000.0, at_first_open=True)
    assert len(first[1]) == 1
    last = bt.account(flat, flat, np.array([0, 0, 1, 0]), 10_000.0)  # bought on the last day, not sold on it
    assert last[1] == [] and last[0][-1] == pytest.approx(10_000 - 5)


def series(start, m20, m5, last):
    at20, at54 = last / (1 + m20 / 100), last / (1 + m5 / 100)
    return [*np.linspace(start, at20, 40), *np.linspace(at20, at54, 14), *np.linspace(at54, last, 6)]


def test_momentum_report(spark):
    stocks = {"NVDA": (12, 9, 130), "MSFT": (9, 6, 110), "GOOGL": (7, 5, 95), "AMZN": (5, 4, 85), "TSLA": (4, 2.7, 70), "AAPL": (2, 1, 60), "AMD": (-3, 0.5, 50)}
    prices = {s: series(60.0, *x) for s, x in stocks.items()} | {"QQQ": series(100.0, 20, 2.5, 120.0), "PSQ": series(30.0, -12, -3, 24.0)}
    rows = [(s, d, float(p)) for s, ps in prices.items() for d, p in zip(DAYS, ps)]
    rows = [r for r in rows if not (r[0] == "AMZN" and r[1] == DAYS[49])] + [("GONE", DAYS[58], 1.0), ("LATE", DAYS[59] + timedelta(1), 5.0), ("NULL", DAYS[59], None)]
    got = bt.momentum_report(spark.createDataFrame(rows, "symbol string, trade_date date, close double"), "QQQ", "PSQ").orderBy("date").collect()
    assert [r.date for r in got] == DAYS[4::5]
    last, before = got[-1], got[-2]
    assert last.top == "NVDA,MSFT,GOOGL,AMZN,TSLA" and last.week_start == DAYS[54] and last.pool_size == 7
    gains = [9.0, 6.0, 5.0, 4.0, 2.7]
    assert last.inverse_w == round((24.0 / prices["PSQ"][55] - 1) * 100, 1) and last.bench_w == round((120.0 / prices["QQQ"][55] - 1) * 100, 1)
    assert last.strategy_w == pytest.approx(round(sum(gains) / 5 * 0.5 + last.inverse_w * 0.5, 1))
    top, old = last.top.split(","), before.top.split(",")
    assert last.added == ",".join(s for s in top if s not in old) and last.kept == ",".join(s for s in top if s in old) and last.removed == ",".join(sorted(set(old) - set(top)))
    assert got[0].added == got[0].top and got[0].removed == "" and got[0].week_start == DAYS[0]
    assert "AMZN" not in got[-3].top.split(",")  # no price on that day


def test_sql_functions_and_their_checks(spark):
    sql.register(spark)
    r = [0.01, -0.02, 0.03, None, 0.005]
    df = spark.createDataFrame([(1, r, [1.0, 2.0, 1.0, 3.0, 2.4]), (2, [], None), (3, [0.01, 0.01], [2.0, 1.0])], "k int, r array<double>, e array<double>")
    df.createOrReplaceTempView("series")
    got = {x.k: x for x in spark.sql("SELECT k, q_sharpe(r) s, q_mdd(e) d, q_var(r, 0.5D) v, q_cvar(r, 0.5D) c, q_calmar(r, e) m, q_sortino(r, 0.001D) o, q_dpi(array(-10D, 4D, 8D)) p, q_moic(0D, 1D) z FROM series").collect()}
    x = np.array([v for v in r if v is not None])
    assert got[1].s == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(244)) and got[1].d == pytest.approx(0.5)
    assert got[1].v == pytest.approx(-0.005) and got[1].c == pytest.approx(0.0075) and got[1].p == pytest.approx(1.2) and got[1].z is None
    assert got[1].m == pytest.approx((np.prod(1 + x) ** (244 / 4) - 1) / 0.5)
    assert got[2].s is None and got[2].d is None and got[3].s is None  # nothing there; a flat series
    named = {(a.k, a.measure): a.value for a in spark.sql("SELECT k, q.* FROM series, LATERAL quant('sharpe', r, rf => 0.01D) q UNION ALL SELECT k, q.* FROM series, LATERAL quant('mdd', e) q").collect()}
    assert named[1, "sharpe"] == pytest.approx((x.mean() - 0.01 / 244) / x.std(ddof=1) * math.sqrt(244)) and named[1, "mdd"] == pytest.approx(0.5) and named[2, "mdd"] is None
    for bad in ("quant('nothing', array(1D))", "quant('cvar', array(1D), level => 1D)", "quant('cvar', array(1D), confidence => 2D)", "chip_histogram(TABLE(series))"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_plans_of_sql_functions_have_no_python(spark):
    sql.register(spark)
    spark.range(9).selectExpr("cast(id as double) as x").createOrReplaceTempView("xs")
    text = spark.sql("SELECT q_sharpe(collect_list(x)) FROM xs")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text
