"""Fundamental screening, valuation and derived metrics, as Columns and relational steps over many companies at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_c = F.col

# Fixed thresholds of the three markets: floor and spread over the risk-free rate, in percent.
HURDLES = {"CN": (3.5, 2.0), "HK": (5.0, 3.0), "US": (4.0, 2.0)}
WEIGHTS = {"r": 0.20, "ev_ebitda": 0.20, "fcf_yield": 0.25, "debt": 0.15, "premium": 0.20}


def hurdle(rf: float, market: str = "CN") -> float:
    low, spread = HURDLES[market]
    return max(low, rf + spread)


def penetrating_return(cash: Column, payout: Column, cap: Column) -> Column:
    """Distributable cash times payout over market value, percent."""
    return F.try_divide(cash * payout, cap) * 100


def return_class(r: Column, rf: float, market: str = "CN") -> Column:
    ii = hurdle(rf, market)
    return F.when(r < rf, "below_rf").when(r < ii / 2, "fail").when(r < ii, "marginal").otherwise("pass")


def floor_price(baselines: list[Column]) -> Column:
    """The mean of the baselines that are there."""
    xs = F.filter(F.array(*baselines), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs))


def wacc(beta: float, rf: float, premium: float, cap: Column, debt: Column, kd: Column, tax: Column) -> Column:
    ke = rf + beta * premium
    total = cap + F.coalesce(debt, F.lit(0.0))
    return F.try_divide(cap, total) * ke + F.try_divide(F.coalesce(debt, F.lit(0.0)), total) * kd * (1 - tax)


def dcf_value(fcf: Column, g1: Column, g: float, rate: Column, years: int = 5) -> Column:
    """Growth fades from ``g1`` to ``g`` over ``years``; then a terminal value. Null where the rate doesn't exceed ``g``."""
    zero = F.struct(fcf.cast("double").alias("f"), F.lit(0.0).alias("v"), F.lit(1.0).alias("d"))

    def step(s: Column, i: Column) -> Column:
        growth = g1 + (F.lit(g) - g1) * (i - 1) / (years - 1)
        f, d = s["f"] * (1 + growth), s["d"] / (1 + rate)
        return F.struct(f.alias("f"), (s["v"] + f * d).alias("v"), d.alias("d"))

    end = lambda s: s["v"] + F.try_divide(s["f"] * (1 + g), rate - g) * s["d"]
    return F.when(rate > g, F.aggregate(F.sequence(F.lit(1), F.lit(years)), zero, step, end))


def sensitivity(df: DataFrame, value: object, rates: list[float], growths: list[float]) -> DataFrame:
    """A row for each pair of shifts; ``value(rate shift, growth)`` is a Column."""
    cells = [F.struct(F.lit(a).alias("d_rate"), F.lit(b).alias("growth"), value(a, b).alias("value")) for a in rates for b in growths]
    return df.withColumn("cell", F.explode(F.array(*cells))).select("*", "cell.*").drop("cell")


def gordon(dps: Column, g: Column, ke: float) -> Column:
    return F.when(g < ke, F.try_divide(dps * (1 + g), F.lit(ke) - g))


def two_stage_ddm(dps: Column, g1: Column, g2: float, ke: float, years: int = 5) -> Column:
    return dcf_value(dps, g1, g2, F.lit(ke), years)


def peg_price(eps: Column, growth: Column) -> Column:
    """The price at PEG 1, growth in percent and at most 80; null without growth."""
    return F.when(growth > 0, eps * F.least(growth * 100, F.lit(80.0)))


def blended(methods: dict[str, tuple[Column, float]]) -> dict[str, Column]:
    """``value``: the weighted mean over the methods that give one; ``cv`` of these; ``agreement`` by 15 and 30 %."""
    pairs = [F.struct(v.cast("double").alias("v"), F.lit(w).alias("w")) for v, w in methods.values()]
    xs = F.filter(F.array(*pairs), lambda p: p["v"].isNotNull() & (p["v"] > 0))
    add = lambda f: F.aggregate(xs, F.lit(0.0), lambda s, p: s + f(p))
    n = F.size(xs)
    mean = F.try_divide(add(lambda p: p["v"]), n)
    spread = F.try_divide(add(lambda p: p["v"] * p["v"]) - n * mean * mean, n - 1)
    cv = F.when(n > 1, F.try_divide(F.sqrt(F.greatest(spread, F.lit(0.0))), mean) * 100)
    agreement = F.when(cv.isNull(), "single").when(cv < 15, "high").when(cv < 30, "medium").otherwise("low")
    return {"value": F.try_divide(add(lambda p: p["v"] * p["w"]), add(lambda p: p["w"])), "cv": cv, "agreement": agreement}


def ttm(df: DataFrame, key: str, year: str, quarter: str, value: str, positive: bool = False) -> DataFrame:
    """Trailing twelve months from cumulative statements: the latest, or last year's plus the change on its same quarter.

    Null if a piece is missing. ``positive``: also if a computed value isn't above 0 (a whole year's passes).
    """
    top = F.max(F.struct(_c(year).alias("y"), _c(quarter).alias("q"))).over(Window.partitionBy(key))
    t = df.withColumn("__top", top)
    at = lambda back, q: F.max(F.when((_c(year) == _c("__top.y") - back) & (_c(quarter) == q), _c(value)))
    q = _c("__top.q")
    # The window has dealt the rows by key already: no further shuffle.
    t = t.groupBy(key).agg(F.max(q).alias("__q"), at(0, q).alias("__latest"), at(1, q).alias("__same"), at(1, F.lit(4)).alias("__annual"))
    computed = _c("__annual") + _c("__latest") - _c("__same")
    computed = F.when(computed > 0, computed) if positive else computed
    return t.select(key, F.when(_c("__q") == 4, _c("__latest")).otherwise(computed).alias("ttm"))


def score_fundamental(roe: Column, margin: Column) -> Column:
    s = 5.0 + F.when(roe > 15, 1.5).when(roe > 10, 1.0).when(roe > 5, 0.5).otherwise(0.0) + F.when(margin > 20, 1.0).when(margin > 10, 0.5).otherwise(0.0)
    return F.least(s, F.lit(10.0))


def score_valuation(pe: Column, pb: Column) -> Column:
    s = 5.0 + F.when(pe < 15, 2.0).when(pe < 25, 1.0).when(pe > 50, -1.0).otherwise(0.0) + F.when(pb < 1.5, 1.0).when(pb < 3, 0.5).when(pb > 5, -0.5).otherwise(0.0)
    return F.least(F.greatest(s, F.lit(1.0)), F.lit(10.0))


def risk_band(debt: Column) -> Column:
    return F.when(debt > 70, "high").when(debt > 50, "medium").otherwise("low")


def pe_valid(pe: Column, pb: Column) -> Column:
    """PE in -100..1000 and PB in 0.1..100; missing ones pass."""
    return F.coalesce(pe.between(-100, 1000), F.lit(True)) & F.coalesce(pb.between(0.1, 100), F.lit(True))


def realtime_pe(price: Column, pre_close: Column, cap: Column, pe_ttm: Column) -> Column:
    """Shares and profit from yesterday's value, today's price: cap_now / (cap / pe_ttm)."""
    return F.try_divide(price * F.try_divide(cap, pre_close), F.try_divide(cap, pe_ttm))


def warnings(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), k) for k, v in rules.items()]))


def surplus_at(aa: Column, lam: Column, sales: Column, k: float) -> Column:
    return aa + lam * (k - 1) * sales


def oe_band(c: Column, d: Column) -> Column:
    """Owner earnings C + D (1 - G) for G from 0.7 to 1.8 in tenths: an array of structs."""
    return F.transform(F.sequence(F.lit(7), F.lit(18)), lambda g: F.struct((g / 10).alias("g"), (c + d * (1 - g / 10)).alias("oe")))


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)
