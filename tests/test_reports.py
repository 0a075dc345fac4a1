"""Report operators on hand-made rows: the branches that derived tables don't reach."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quantloom.operators import reports as rp


def test_thresholds_and_verdicts(spark):
    rows = [(2.5, "HK"), (1.0, "HK"), (3.0, "US"), (1.0, "CN"), (2.0, "other"), (None, "CN")]
    got = [r.x for r in spark.createDataFrame(rows, "rf double, m string").select(rp.threshold(F.col("rf"), F.col("m")).alias("x")).collect()]
    assert got == [5.5, 5.0, 5.0, 3.5, 4.0, None]
    premiums = [-1.0, 0.0, 0.1, 30.0, 80.0, 150.0, 151.0, None]
    got = [r.v for r in spark.createDataFrame([(p,) for p in premiums], "p double").select(rp.verdict(F.col("p")).alias("v")).collect()]
    assert got == ["below_floor", "below_floor", "near", "near", "fair", "high", "extreme", None]
    got = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0)], "a double, b double").select(rp.total_of(F.col("a"), F.col("b")).alias("t")).collect()
    assert [r.t for r in got] == [1.0, None, 3.0]


def test_dashboard_floors(spark):
    kind = "code int, yr int, cash double, tradable double, debt double, equity double, assets double, goodwill double, operating double, finance_exp double, profit double, da double, ocf double, capex double, dps double"
    year = lambda c, y, ocf, dps: (c, y, 50.0, 10.0, 20.0, 200.0, 400.0, 40.0, 30.0, 5.0, 25.0, 15.0, ocf, 10.0, dps)
    rows = [year(1, 2023, 40.0, 0.5), year(1, 2022, 30.0, None), year(1, 2021, 20.0, 0.4), year(1, 2020, 60.0, 0.3), year(1, 2019, 60.0, 9.0), year(2, 2023, 5.0, None), year(3, 2023, 5.0, None)]
    basics = spark.createDataFrame([(1, 5.0, 500.0, 100.0), (2, 5.0, 500.0, 100.0), (3, 0.0, 1.0, 1.0)], "code int, close double, cap double, shares double")
    got = {r.code: r for r in rp.value_dashboard(spark.createDataFrame(rows, kind), basics, spark.createDataFrame([(1, 2.0)], "code int, low double"), 2.0).collect()}
    one = got[1]
    assert (one.ev, one.ebitda, one.ev_ebitda, one.cash_pe, one.fcf_yield, one.pb) == (470.0, 50.0, 9.4, 470 / 25, 6.0, 2.5)
    floors = [40 / 100, 2.0, 2.0, 0.4 / 0.03, 10 / 0.02 / 100]  # dividends of 2023, 2021 and 2020; the least free cash is 10
    assert [one.floor_liquid, one.floor_equity, one.floor_low, one.floor_dividend, one.floor_cash] == pytest.approx(floors)
    assert one.floor == pytest.approx(sum(floors) / 5) and one.n_floors == 5 and one.premium == pytest.approx((5 / one.floor - 1) * 100) and one.dividend_yield == pytest.approx(10.0)
    assert got[2].n_floors == 2 and got[2].floor_cash is None and got[2].dividend_yield is None and 3 not in got
    without = rp.value_dashboard(spark.createDataFrame(rows, kind), basics, spark.createDataFrame([(1, 2.0)], "code int, low double"), None).where("code = 1").first()
    assert without.n_floors == 3


def test_ranges_take_the_right_dates(spark):
    rows = [("a", date(2020, 1, 1), 99.0, 1.0, 5.0, 1.0), ("a", date(2023, 3, 1), 9.0, 2.0, 3.0, 10.0), ("a", date(2023, 5, 1), 9.0, 2.0, 6.0, 20.0), ("a", date(2024, 1, 1), 8.0, 3.0, 4.0, 30.0)]
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, high double, low double, close double, volume double")
    r = rp.year_range(bars).first()
    assert (r.high, r.high_date, r.low, r.low_date, r.close, r.mean_volume, r.rise) == (9.0, date(2023, 5, 1), 2.0, date(2023, 5, 1), 4.0, 20.0, 100.0)
    ten = {x.year: x for x in rp.ten_years(bars).collect()}
    assert sorted(ten) == [2020, 2023, 2024] and ten[2023].close == 6.0 and ten[2023].high_date == date(2020, 1, 1) and ten[2023].rise == pytest.approx(300.0)
    ties = spark.createDataFrame(rows[1:], bars.schema)
    assert {(x.high_date, x.low_date) for x in rp.ten_years(ties).collect()} == {(date(2023, 3, 1), date(2023, 3, 1))}


def test_lookups(spark):
    t = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("b", "x", 4), ("c", "z", 5), ("d", None, 6)], "symbol string, data_source string, v int")
    assert sorted(r.v for r in rp.by_source_priority(t, ["y", "x"]).collect()) == [2, 3, 4]
    config = spark.createDataFrame([("a", 1, True), ("b", 5, False), ("c", 5, True), ("d", None, True)], "name string, priority int, enabled boolean")
    assert rp.enabled_sources(config) == ["c", "a", "d"]
    p = spark.createDataFrame([("q4", None), ("q3", 1.0), ("q3", None), ("q1", 2.0)], "period string, roe double")
    assert [r.roe for r in rp.first_with_data(p, "period", ["q4", "q3", "q1"], "roe").collect()] == [1.0]
    assert rp.first_with_data(p, "period", ["none"], "roe").count() == 0


def test_dividends_by_year_and_holders_of_the_newest_period(spark):
    rows = [(1, date(2024 - k // 2, 6 * (k % 2) + 1, 1), "done", k) for k in range(14)] + [(1, date(2024, 1, 1), "done", 99), (1, date(2024, 3, 1), "planned", 98)]
    got = rp.paid_dividends(spark.createDataFrame(rows, "code int, end_date date, status string, k int"), [F.col("k")]).collect()
    assert sorted(r.k for r in got) == list(range(10))
    h = spark.createDataFrame([(1, "2023", "old", 9.0), (1, "2024", "x", 1.0), (1, "2024", "y", 2.0), (2, "2020", "z", 3.0)], "code int, period string, holder string, amount double")
    got = rp.newest_holders(h, "period", [F.desc("amount")], 1).collect()
    assert sorted((r.code, r.holder, r.place) for r in got) == [(1, "y", 1), (2, "z", 1)]
