"""Roots found for whole batches: as many calls as one root takes, and the same values as one at a time."""

import datetime as dt
import math

import numpy as np

from quantloom.operators import quant


def one_root(f, lo, hi):
    a, b = f(lo), f(hi)
    if not (math.isfinite(a) and math.isfinite(b)) or a * b > 0:
        return math.nan
    for _ in range(200):
        mid = (lo + hi) / 2
        c = f(mid)
        if c == 0 or hi - lo < 1e-13 * max(1.0, abs(mid)):
            return mid
        lo, hi, a = (mid, hi, c) if a * c > 0 else (lo, mid, a)
    return (lo + hi) / 2


def test_roots_of_a_batch_take_the_calls_of_one():
    want = np.concatenate([np.linspace(0.1, 4.9, 5000), [-1.0, np.nan, 2.5]])
    calls = []

    def f(i, x):
        calls.append(len(i))
        return x**3 - want[i] ** 3

    got = quant._roots(f, len(want), 0.0, 5.0)
    np.testing.assert_array_equal(got, [one_root(lambda x, w=w: x**3 - w**3, 0.0, 5.0) for w in want])
    assert np.isnan(got[-3:-1]).all() and len(calls) < 70 and calls[-1] < len(want)
    assert len(quant._roots(f, 0, 0.0, 5.0)) == 0


def test_volatilities_of_a_batch(spark):
    rows = [(i, 100.0, 80.0 + i, t, 0.03, v, i % 2 == 0) for i in range(40) for t in (0.0, 0.5, 3.0) for v in (0.0, 0.1, 0.9)]
    t = spark.createDataFrame(rows, "id long, s double, k double, t double, r double, v double, call boolean").coalesce(1)
    got = quant.option_values(t).collect()
    assert len(got) == len(rows)
    for r in got:
        if not (r.t > 0 and r.v > 0 and r.vega > 1e-8):
            assert r.iv is None
            continue
        arg = lambda x: np.array([x])
        want = one_root(lambda x, r=r, arg=arg: float(quant._price(arg(r.s), arg(r.k), arg(r.t), arg(r.r), arg(x), arg(r.call))[0]) - r.price, 1e-6, 5.0)
        assert r.iv == (None if math.isnan(want) else want)


def test_rates_of_many_keys_without_a_group_each(spark, monkeypatch):
    day = dt.date(2020, 1, 1)
    flows = {k: [(day + dt.timedelta(days=37 * i * (k % 5 + 1)), float((i * 7919 + k * 104729) % 1000 - 480)) for i in range(k % 23 + 1)] for k in range(300)}
    flows[1001] = [(day, -100.0), (day, -50.0), (day + dt.timedelta(days=365), 165.0)]
    flows[1002] = [(day, -100.0), (day, None), (day + dt.timedelta(days=730), 121.0)]
    flows[1003] = [(day, None)]
    flows[1004] = [(day, -1.0), (None, 2.0)]
    rows = [(k, d, a) for k, fs in flows.items() for d, a in fs]
    t = spark.createDataFrame(rows, "code long, d date, a double")
    monkeypatch.setattr(quant, "FLOWS", 64)
    out = quant.xirr(t, "code", "d", "a")
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.code: r.rate for r in out.collect()}
    assert got.keys() == flows.keys()
    assert abs(got[1001] - 0.1) < 1e-3 and abs(got[1002] - 0.1) < 1e-3 and got[1003] is None and got[1004] is None
    for k in range(300):
        a = np.array([x for _, x in flows[k]])
        days = np.array([(d - day).days for d, _ in flows[k]]) / 365.0
        want = one_root(lambda r, a=a, days=days: float((a / (1 + r) ** days).sum()), -0.9999, 1e6) if (a > 0).any() and (a < 0).any() else math.nan
        assert got[k] == (None if math.isnan(want) else want), k
