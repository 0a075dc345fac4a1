"""The valuation of hand-made companies, one for each class and each method's edge."""

import re

import pytest

from quantloom.operators import valuation as va

YEARS = "code int, yr int, " + ", ".join(f"{f} double" for f in va.FIELDS)
BASICS = "code int, close double, pe double, cap double, shares double"


def company(code, n=5, **fields):
    """``fields``: constants or functions of the year's age (0: newest)."""
    return [(code, 2024 - k, *(fields.get(f)(k) if callable(fields.get(f)) else fields.get(f) for f in va.FIELDS)) for k in range(n)]


@pytest.fixture(scope="module")
def valued(spark):
    rows = [
        *company(1, revenue=lambda k: 1000.0 - 10 * k, profit=100.0, eps=1.0, roe=20.0, payout=50.0, ocf=150.0, capex=-50.0, cash=10.0, close=10.0, dps=0.5, tax=20.0, pre_tax=120.0),
        *company(2, revenue=lambda k: 1000 / 1.5**k, profit=lambda k: 100 / 1.4**k, eps=1.0, close=lambda k: 10.0 + k, ocf=100.0, capex=10.0, da=5.0),
        *company(3, revenue=lambda k: 1000 / 1.1**k, profit=lambda k: 100 / 1.1**k, eps=1.0, close=10.0, payout=10.0, dps=0.1, ocf=100.0, capex=0.0, debt=1e6, finance_exp=8e4),
        *company(4, revenue=100.0, profit=lambda k: -5.0 if k == 0 else 5.0, eps=-0.1, close=3.0, roe=30.0, payout=40.0),
        *company(5, n=1, revenue=100.0),
    ]
    basics = [(1, 10.0, 10.0, 1000.0, 100.0), (2, 20.0, 20.0, 2e12, 100.0), (3, 10.0, 12.0, 1e6, 100.0), (4, 3.0, None, 300.0, 100.0), (5, None, None, None, None), (6, 1.0, 1.0, 1.0, 1.0)]
    df = va.run(spark.createDataFrame(rows, YEARS), spark.createDataFrame(basics, BASICS))
    return df, {r.code: r for r in df.collect()}


def test_classes_choose_methods(valued):
    _, got = valued
    assert {k: r.kind for k, r in got.items()} == {1: "blue", 2: "growth", 3: "mixed", 4: "growth", 5: "mixed"}
    assert got[1].methods == "DCF,DDM,PE_Band" and got[2].methods == "DCF_Scenarios,PEG,PS" and got[4].methods == "PS"
    assert got[3].DDM is None and "PE_Band" in got[3].methods  # hardly pays, so it has no dividend method
    assert got[5].methods == "" and got[5].value is None and got[5].agreement == "none"


def test_rates(valued):
    _, got = valued
    assert got[1].ke == pytest.approx(2.5 + 1.2 * 6) and got[1].wacc == got[1].ke
    assert got[2].ke == pytest.approx(2.5 + 0.8 * 6)
    # Half debt at 8e4 / 1e6, taxed at the market's rate.
    assert got[3].wacc == pytest.approx(got[3].ke / 2 + 8 * 0.75 / 2)


def test_values(valued):
    _, got = valued
    one = got[1]
    ke, g = one.ke / 100, 0.0  # dividends don't grow, so Gordon's model holds at no growth
    assert one.DDM == pytest.approx(0.5 / (ke - g)) and one.PE_Band == pytest.approx(10.0)
    flows, f = [], 100.0
    past = (1000 / 960) ** 0.25 - 1
    g1, gt = past * 0.8, 0.03
    fade = (g1 + gt) / 2
    for x in (g1, g1, fade, (fade + gt) / 2, gt):
        f *= 1 + x
        flows.append(f)
    worth = sum(v / (1 + ke) ** i for i, v in enumerate(flows, 1)) + flows[-1] * 1.03 / (ke - 0.03) / (1 + ke) ** 5
    assert one.DCF == pytest.approx((worth + 10) / 100)
    assert one.value == pytest.approx((40 * one.DCF + 30 * one.DDM + 30 * one.PE_Band) / 100)
    assert got[2].PEG == pytest.approx(40.0 * 20 / 20) and got[2].PS == pytest.approx(sorted((10 + k) * 100 / (1000 / 1.5**k) for k in range(5))[2] * 1000 / 100)
    assert got[4].value == pytest.approx(got[4].PS) and got[4].cv == 0 and got[4].agreement == "high"


def test_what_the_price_implies(valued):
    _, got = valued
    one = got[1]
    assert one.implied_g_earnings == pytest.approx(one.ke - 10) and one.implied_g_fcf == pytest.approx(one.wacc - 10)
    assert one.implied_g_dividend == pytest.approx((10 * one.ke / 100 - 0.5) / 10.5 * 100) and one.implied_wacc == pytest.approx(10.0)
    assert got[4].implied_g_earnings is None and got[5].implied_g_fcf is None


def test_one_shuffle_of_the_years_and_no_python(valued):
    text = valued[0]._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)
    assert len(set(re.findall(r"Exchange hashpartitioning\(code#\d+, \d+\)", text))) <= 2
