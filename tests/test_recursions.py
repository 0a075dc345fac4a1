"""Native scans against plain loops: nulls, seeds, chunk borders, and the plans of whole sets of indicators."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import folds, recursions
from quantloom.functions.recursions import Recursion
from quantloom.operators import factors
from quantloom.operators import indicators as ind

DAYS = [f"2020-{m:02d}-{d:02d}" for m in range(1, 11) for d in range(1, 29)]


def series(n, gaps, seed):
    rng = random.Random(seed)
    out, x = [], 50.0
    for _ in range(n):
        x = max(1.0, x + rng.gauss(0, 1))
        out.append(None if gaps and rng.random() < 0.15 else x)
    return out


def panel(spark, gaps=False):
    rows = [(s, d, c and c + 1.0, c and c - 1.0, c, 100.0, "extra") for s, n in (("a", 250), ("b", 30), ("c", 1), ("d", 5)) for d, c in zip(DAYS, series(n, gaps, s))]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, trade_date string, high double, low double, close double, volume double, note string")


def by_symbol(df, *columns):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.symbol, r.trade_date)):
        out.setdefault(r.symbol, []).append([math.nan if r[c] is None else r[c] for c in columns])
    return {k: np.array(v, float).T for k, v in out.items()}


@pytest.mark.parametrize("chunk", [1, 7, 64, 1024])
@pytest.mark.parametrize("gaps", [False, True])
def test_scans_equal_loops_at_any_chunk(spark, chunk, gaps):
    df = panel(spark, gaps)
    b = ind.Build()
    b.seeded("close", 5, "ema"), b.seeded("close", 4, "wilder"), b.from_first("close", 0.3)
    b.recursion(ind.FIRST_SCAN, "sum", Recursion("close", recursions.decayed(0.9), 0.9, initial=10.0))
    for layer in b.layers[:3]:
        df = df.withColumns(layer) if layer else df
    got = recursions.scan(df, b.layers[3], chunk)
    assert got.columns == [*df.columns, *b.layers[3]]
    names = list(b.layers[3])
    for s, (close, *states) in by_symbol(got, "close", *names).items():
        total, sums = 10.0, []
        for x in close:
            total = total if math.isnan(x) else total * 0.9 + x
            sums.append(total)
        want = [folds.ema_seeded(close, 5), folds.wilder(close, 4), folds.ema_first(close, 0.3), np.array(sums)]
        for a, e in zip(states, want):
            np.testing.assert_allclose(a, e, rtol=1e-12)


def test_resets_set_the_state_anew(spark):
    rows = [("a", d, float(k % 5), 100.0 if k % 13 == 4 else None) for k, d in enumerate(DAYS[:60])]
    df = spark.createDataFrame(rows, "symbol string, trade_date string, x double, reset double")
    got = by_symbol(recursions.scan(df, {"s": Recursion("x", recursions.decayed(0.5), 0.5, seed="reset")}, 9), "s")["a"][0]
    want, state = [], math.nan
    for _, _, x, reset in rows:
        state = reset if reset is not None else state * 0.5 + x
        want.append(state)
    np.testing.assert_allclose(got, want)


def test_indicators_with_gaps_equal_folds(spark):
    df = panel(spark, gaps=True)
    got = by_symbol(ind.b_kdj(df), "k", "d", "j")
    for s, (high, low, close) in by_symbol(df, "high", "low", "close").items():
        want = folds.kdj(high, low, close)
        for a, e in zip(got[s], (want["k"], want["d"], want["j"])):
            np.testing.assert_allclose(a, e, rtol=1e-12)


def test_rsi_14_has_no_window(spark):
    rows = [("a", f"{1900 + k // 300}-{k % 300:03d}", 1e6 if k == 1 else float(k % 3)) for k in range(1500)]
    df = spark.createDataFrame(rows, "symbol string, trade_date string, close double")
    got = by_symbol(factors.compute_factor(df, "RSI_14"), "value")["a"][0]
    gain = loss = 0.0
    for (_, _, a), (_, _, b) in zip(rows, rows[1:]):
        gain, loss = gain * 13 / 14 + max(b - a, 0), loss * 13 / 14 + max(a - b, 0)
    assert got[-1] == pytest.approx(100 * gain / (gain + loss), rel=1e-12) and np.isnan(got[:14]).all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sets_of_indicators_plan_one_shuffle_and_no_python(spark):
    bars = panel(spark)
    sets = [
        ind.calculate_indicators(bars, {k: True for k in ind.BUILT}),
        ind.compute_many(bars, [ind.IndicatorSpec(k) for k in ind.SPECS]),
        ind.add_all_indicators(bars),
        ind.add_all_indicators(bars, "china"),
        factors.compute_factor(bars, "RSI_14"),
    ]
    for df in sets:
        text = plan(df)
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
        assert not re.search("Join|Python|Pandas|Arrow", text)


def test_specs_append_replace_and_are_deduplicated(spark):
    bars = panel(spark)
    spec = ind.IndicatorSpec
    one = ind.compute_indicator(bars, spec("MA", {"period": 3}))
    assert one.columns == [*bars.columns, "ma3"]
    many = ind.compute_many(bars, [spec("boll"), spec("boll", {"n": 5}), spec("boll"), spec("ma", {"n": 3}), spec("MA", {"n": 3})])
    assert many.columns == [*bars.columns, "boll_mid", "boll_upper", "boll_lower", "ma3"]
    five = {(r.symbol, r.trade_date): r.mid for r in ind.b_boll(bars, 5).collect()}
    assert all(r.boll_mid == pytest.approx(five[r.symbol, r.trade_date]) for r in many.collect())
    assert ind.compute_many(bars, []).columns == bars.columns
    assert ind.compute_indicator(bars.withColumn("ma3", F.lit("old")), spec("ma", {"n": 3})).schema["ma3"].dataType.typeName() == "double"
    for bad in (spec("nothing"), spec("atr")):
        with pytest.raises(ValueError):
            ind.compute_indicator(bars.drop("high"), bad)
