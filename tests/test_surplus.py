"""Surplus, payout reconciliation and the grid on companies made for each branch."""

import pytest

from quantloom.operators import surplus as sp

SURPLUS = "code int, yr int, tcr double, w double, capex double, revenue double"
PAYOUT = "code int, yr int, eps double, profit double, dps double, dps_hkd double, dist double, payout double"


def test_surplus_of_each_branch(spark):
    rows = [
        # 1: rising with revenue, one year without w, one without capex
        (1, 2018, 100.0, 40.0, 10.0, 200.0), (1, 2019, 120.0, None, 10.0, 220.0), (1, 2020, 140.0, 50.0, None, 260.0), (1, 2021, 150.0, 50.0, 20.0, 250.0),
        # 2: one year, negative
        (2, 2020, 10.0, 30.0, 0.0, 50.0),
        # 3: revenue hardly moves
        (3, 2018, 50.0, 10.0, 0.0, 100.0), (3, 2019, 52.0, 10.0, 0.0, 101.0), (3, 2020, 53.0, 10.0, 0.0, 102.0),
        # 4: no year counts; 5: revenue the same, missing or below 0
        (4, 2020, None, 1.0, 1.0, 5.0), (5, 2019, 5.0, 1.0, 0.0, 0.0), (5, 2020, 6.0, 1.0, 0.0, None), (5, 2021, 6.0, 9.0, 0.0, -1.0),
    ]
    got = {r.code: r for r in sp.surplus(spark.createDataFrame(rows, SURPLUS)).collect()}
    assert sorted(got) == [1, 2, 3, 5]
    one = got[1]  # 50, 90 and 80 in 2018, 2020 and 2021; changes 40 / 60 and -10 / -10
    assert (one.years, one.aa_all, one.aa_2y, one.aa_excl, one.aa) == (3, pytest.approx(220 / 3), 85, pytest.approx(220 / 3), 85)
    assert one["lambda"] == pytest.approx((40 / 60 + 1) / 2) and one.reliability == "normal" and not one.mixed_signs
    two = got[2]
    assert (two.aa, two.aa_excl, two["lambda"], two.cv, two.reliability) == (-20, -20, None, None, "normal")
    three = got[3]
    assert three.low_amplitude and three["lambda"] == pytest.approx(1.5) and three.reliability == "one"
    five = got[5]  # the only change of revenue is by -1, that of surplus by -8
    assert five["lambda"] == pytest.approx(8) and five.odd_lambda and five.reliability == "several" and five.aa_excl == pytest.approx(4.5)
    assert sp.surplus(spark.createDataFrame([], SURPLUS)).count() == 0


def test_payout_rules(spark):
    def years(code, **k):
        return [(code, 2020 - i, k.get("eps", 1.0), k.get("profit", 100.0), *(k[x][i] if x in k else None for x in ("dps", "dps_hkd", "dist", "payout"))) for i in range(4)]

    rows = [
        *years(1, dps=[0.3, 0.31, 0.29, 9.0], dist=[30.0, 31.0, 29.0, 900.0], payout=[30.0, 30.0, 31.0, 900.0]),  # agree; the fourth year is out
        *years(2, dps=[0.3, 0.3, 0.3, 0.3], dist=[30.0, 30.0, 30.0, 30.0], payout=[30.0, 30.0, 30.0, 30.0]),  # the same dividend each year
        *years(3, dps=[0.3, 0.3, 0.3, 0.2], dist=[60.0, 60.0, 60.0, 0.0], payout=[30.0, 30.0, 30.0, 0.0]),  # apart
        *years(4, dps_hkd=[0.3, 0.3, 0.3, 0.3], dist=[30.0, 30.0, 30.0, 30.0]),  # another currency, no series
        *years(5, dps=[0.5, 0.4, 0.3, 0.2]),  # only the first
        *years(6, eps=-1.0, profit=-1.0, dps=[0.5, 0.4, 0.3, 0.2], dist=[1.0] * 4),  # nothing to divide by
        *years(7, dps=[0.3, None, None, None], dist=[None, 45.0, None, None], payout=[None, None, 20.0, None]),
    ]
    got = {r.code: r for r in sp.payout_crosscheck(spark.createDataFrame(rows, PAYOUT)).collect()}
    assert {k: (r.rule, r.label) for k, r in got.items()} == {1: ("agree", "m3"), 2: ("filled_in", "m2"), 3: ("apart", "m2"), 4: ("no_series", "m2"), 5: ("only_first", "m1"), 7: ("apart", "m2")}
    assert got[1].m == pytest.approx(91 / 3) and not got[1].identical_dps
    assert got[3].pair == "m1/m2" and got[3].max_dev == pytest.approx(30 / 45) and got[3].m == 60
    assert got[4].currency_note and got[4].m1 == pytest.approx(30) and got[4].pair is None
    assert got[7].pair == "m2/m3" and got[7].max_dev == pytest.approx(25 / 32.5)


def test_grid_drops_near_values_in_order(spark):
    kind = "code int, c double, cap double, close double, ii double, m1 double, m2 double, m3 double, label string, aa_2y double, aa_all double, aa_excl double"
    rows = [
        (1, 100.0, 1000.0, 10.0, 5.0, 30.0, 30.4, 30.8, "m2", 1e6, 1e6 + 9999, 1e6 + 10001),  # m2 first takes both others out; aa_excl is far enough from aa_2y
        (2, 100.0, 1000.0, 10.0, 0.0, 30.0, None, 30.5, "m1", 5.0, None, 5.0),  # half a point is far enough; no threshold, no target
        (3, 100.0, 0.0, 10.0, 5.0, 30.0, 30.0, 30.0, "m1", 1.0, 1.0, 1.0),  # no value, no row
    ]
    got = sp.penetration_grid(spark.createDataFrame(rows, kind), [0.0, 20.0], 20.0).collect()
    at = {(r.code, r.base, r.ratio, r.q): r for r in got}
    assert sorted(at) == sorted(
        [(1, a, "m2", q) for a in ("aa_2y", "aa_excl") for q in (0.0, 20.0)] + [(2, "aa_2y", m, q) for m in ("m1", "m3") for q in (0.0, 20.0)]
    )
    r = at[1, "aa_2y", "m2", 20.0]
    assert r.gg == pytest.approx(1e6 * 0.304 * 0.8 / 1000 * 100) and r.r == pytest.approx(100 * 0.304 * 0.8 / 1000 * 100)
    assert r.hh == pytest.approx(r.r - r.gg) and r.target == pytest.approx(10 * r.gg / 5) and r.recommended
    assert at[1, "aa_2y", "m2", 0.0].target == pytest.approx(r.target) and at[2, "aa_2y", "m3", 0.0].target == 0 and not at[2, "aa_2y", "m3", 0.0].recommended
