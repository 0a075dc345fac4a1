"""A whole valuation as one plan: class, discount rate, the class's methods, their agreement, and what the price implies.

A company's years become one array, newest first (a company has few); everything after that is Columns over one row a
company, so the plan has one shuffle by company. A method is computed only where the class uses it: conditions are
evaluated before values, row by row.

``years`` has ``code, yr`` and ``revenue, profit, eps, roe, payout, ocf, capex, da, tax, pre_tax, finance_exp, debt, cash, close``
(year's last price), ``dps``; money in units of the currency, percent as such, nulls where unknown. ``basics`` has
``code, close, pe, cap`` (market value) and ``shares``. Rates and growth are in percent throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_c = F.col
FIELDS = "revenue profit eps roe payout ocf capex da tax pre_tax finance_exp debt cash close dps".split()

# Thresholds of the classes, weights of their methods, betas by market value in millions, rates of the markets.
ROE_BLUE, PAYOUT_BLUE, REVENUE_GROWTH, PROFIT_GROWTH = 15.0, 30.0, 20.0, 25.0
WEIGHTS = {
    "blue": {"DCF": 40, "DDM": 30, "PE_Band": 30},
    "growth": {"PEG": 35, "DCF_Scenarios": 35, "PS": 30},
    "mixed": {"DCF": 35, "PE_Band": 25, "PEG": 25, "DDM": 15},
}
BETAS = [(1_000_000, 0.8), (100_000, 1.0), (0, 1.2)]
MARKETS = {"A": (6.0, 2.5, 25.0, 3.0), "HK": (5.5, 4.0, 16.5, 2.5), "US": (5.0, 4.0, 21.0, 2.5)}
METHODS = ["DCF", "DCF_Scenarios", "DDM", "PE_Band", "PEG", "PS"]


@dataclass(frozen=True)
class Market:
    """Premium of shares, riskless rate, tax rate and growth for good, in percent."""

    erp: float
    rf: float
    tax: float
    g: float

    @classmethod
    def of(cls, name: str) -> Market:
        return cls(*MARKETS[name])


def _mean(xs: Column) -> Column:
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs))


def _deviation(xs: Column) -> Column:
    """Of a sample; null below two values."""
    m = _mean(xs)
    return F.when(F.size(xs) > 1, F.sqrt(F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(xs) - 1)))


def _there(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull())


def _growth(xs: Column) -> Column:
    """Yearly growth in percent between the oldest and the newest of the values above 0; null below two."""
    ok = F.filter(xs, lambda x: x > 0)
    n = F.size(ok)
    return F.when(n > 1, (F.pow(F.get(ok, F.lit(0)) / F.get(ok, n - 1), 1.0 / (n - 1)) - 1) * 100)


def _quantile(xs: Column, p: float) -> Column:
    """Of a sorted array, between neighbours."""
    k = (F.size(xs) - 1) * F.lit(p)
    low, high = F.floor(k).cast("int"), F.ceil(k).cast("int")
    return F.when(low == high, F.get(xs, low)).otherwise(F.get(xs, low) * (high - k) + F.get(xs, high) * (k - low))


def by_company(years: DataFrame) -> DataFrame:
    """``code`` and ``h``: the company's years as an array of structs, newest first."""
    row = F.struct((-_c("yr")).alias("k"), "yr", *[_c(f).cast("double").alias(f) for f in FIELDS])
    return years.groupBy("code").agg(F.array_sort(F.collect_list(row)).alias("h"))


def _last(field: str, n: int | None = None) -> Column:
    h = F.slice("h", 1, n) if n else _c("h")
    return F.transform(h, lambda r: r[field])


def classified(t: DataFrame) -> DataFrame:
    """Adds averages, growth, scores, ``kind`` and ``weights`` (method to weight): a mixed company that hardly pays has no dividend method."""
    t = t.withColumns({
        "roe_avg": _mean(_there(_last("roe", 5))), "payout_avg": _mean(_there(_last("payout", 3))),
        "revenue_growth": _growth(_last("revenue", 5)), "profit_growth": _growth(_last("profit", 5)),
    })
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    blue = yes(_c("roe_avg") > ROE_BLUE) + yes(_c("payout_avg") > PAYOUT_BLUE) + yes(_c("revenue_growth") < REVENUE_GROWTH)
    growth = yes(_c("revenue_growth") > REVENUE_GROWTH) + yes(_c("profit_growth") > PROFIT_GROWTH)
    t = t.withColumns({"blue": blue, "growth": growth})
    kind = F.when((_c("blue") >= 2) & (_c("growth") == 0), "blue").when((_c("growth") >= 2) & (_c("blue") <= 1), "growth").otherwise("mixed")
    t = t.withColumn("kind", F.when(F.get("h", F.lit(0))["profit"] < 0, "growth").otherwise(kind))
    plain = {k: F.create_map(*[F.lit(x) for m, w in ws.items() for x in (m, w)]) for k, ws in WEIGHTS.items()}
    spread = WEIGHTS["mixed"]["DDM"] // (len(WEIGHTS["mixed"]) - 1)
    without = F.create_map(*[F.lit(x) for m, w in WEIGHTS["mixed"].items() if m != "DDM" for x in (m, w + spread)])
    frugal = (_c("kind") == "mixed") & (_c("payout_avg") <= 20)
    weights = F.when(frugal, without).when(_c("kind") == "blue", plain["blue"]).when(_c("kind") == "growth", plain["growth"]).otherwise(plain["mixed"])
    return t.withColumn("weights", weights)


def discounted(t: DataFrame, market: Market) -> DataFrame:
    """Adds ``ke`` and ``wacc``: cost of shares by a beta of the market value, of debt by what was paid on its two years' mean."""
    cap = F.coalesce("cap", F.lit(0.0))
    beta = F.lit(1.0)
    for least, b in reversed(BETAS):
        beta = F.when(cap / 1e6 > least, b).otherwise(beta)
    debt = F.coalesce(F.get("h", F.lit(0))["debt"], F.lit(0.0))
    both = (debt + F.coalesce(F.get("h", F.lit(1))["debt"], F.lit(0.0))) / 2
    paid = F.get("h", F.lit(0))["finance_exp"]
    kd = F.when((paid > 0) & (both > 0), paid / both * 100).otherwise(market.rf + 1.0)
    taxes = F.transform(F.filter(F.slice("h", 1, 5), lambda r: r["tax"].isNotNull() & (r["pre_tax"] > 0)), lambda r: r["tax"] / r["pre_tax"] * 100)
    t = t.withColumns({"ke": market.rf + beta * market.erp, "debt": debt, "kd": kd, "tax_rate": F.coalesce(_mean(taxes), F.lit(market.tax))})
    total = cap + _c("debt")
    mixed = _c("ke") * cap / total + _c("kd") * (1 - _c("tax_rate") / 100) * _c("debt") / total
    return t.withColumn("wacc", F.when(_c("debt") > 0, mixed).otherwise(_c("ke")))


def _present(flows: list[Column], rate: Column, g: Column, floor: bool = False) -> Column:
    """Value of the flows and of what follows at growth ``g``; with ``floor`` nothing follows a last flow of 0 or less."""
    one = 1 + rate / 100
    after = flows[-1] * (1 + g / 100) / (rate / 100 - g / 100)
    after = F.when(flows[-1] > 0, after).otherwise(0.0) if floor else after
    return sum((f / F.pow(one, F.lit(float(i))) for i, f in enumerate(flows, 1)), F.lit(0.0)) + after / F.pow(one, F.lit(5.0))


def _terminal(market: Market) -> Column:
    return F.when(_c("wacc") <= market.g, _c("wacc") - 2.0).otherwise(market.g)


def _free_cash(n: int) -> Column:
    return F.transform(F.filter(F.slice("h", 1, n), lambda r: r["ocf"].isNotNull() & r["capex"].isNotNull()), lambda r: r["ocf"] - F.abs(r["capex"]))


def _per_share(firm: Column) -> Column:
    return (firm + F.coalesce(F.get("h", F.lit(0))["cash"], F.lit(0.0)) - _c("debt")) / _c("shares")


def dcf(market: Market) -> Column:
    """Free cash of three years, growing at four fifths of its past growth (else the revenue's, else 5 %), fading to growth for good."""
    flows = _free_cash(5)
    past = _growth(flows)
    g1 = F.when(past > 0, past).otherwise(F.coalesce("revenue_growth", F.lit(5.0))) * 0.8
    g = _terminal(market)
    fade = (g1 + g) / 2
    rates, f, projected = [g1, g1, fade, (fade + g) / 2, g], _mean(F.slice(flows, 1, 3)), []
    for x in rates:
        f = f * (1 + x / 100)
        projected.append(f)
    return F.when(F.size(flows) > 1, _per_share(_present(projected, _c("wacc"), g)))


def dcf_scenarios(market: Market) -> Column:
    """A quarter good, a half base, a quarter bad: shares of the revenue's growth, margins that drift, capital spending by revenue."""
    now = F.get("h", F.lit(0))
    revenue = F.coalesce(now["revenue"], F.lit(0.0))
    growth = F.coalesce("revenue_growth", F.lit(10.0))
    margin = F.when(revenue > 0, F.coalesce(now["profit"], F.lit(0.0)) / revenue * 100).otherwise(5.0)
    spending = F.when(revenue > 0, F.abs(F.coalesce(now["capex"], F.lit(0.0))) / revenue).otherwise(0.05)
    da, g = F.coalesce(now["da"], F.lit(0.0)), _terminal(market)

    def value(shares: list[float], drift: float, capex: float) -> Column:
        sold, flows = revenue, []
        for i, share in enumerate(shares, 1):
            sold = sold * (1 + growth * share / 100)
            flows.append(sold * (margin + drift * i) / 100 + da - sold * spending * capex)
        return _per_share(_present(flows, _c("wacc"), g, floor=True))

    return 0.25 * value([1.0] * 5, 0.5, 1.0) + 0.5 * value([0.7] * 5, 0.0, 1.0) + 0.25 * value([0.4, 0.4, 0, 0, 0], -0.3, 1.2)


def _dividends() -> Column:
    return F.filter(_last("dps"), lambda x: x > 0)


def ddm(market: Market) -> Column:
    """Gordon's model for slow and even dividends, else two stages; null below three years of dividends."""
    dps, paid, ke = _dividends(), F.slice(_there(_last("payout")), 1, 3), _c("ke")
    average, now = _mean(paid), F.get(dps, F.lit(0))
    g1 = F.coalesce(_growth(dps), F.lit(2.0))
    uneven = F.when(average > 0, F.coalesce(_deviation(paid), F.lit(0.0)) / average).otherwise(0.0)
    kept = F.when((_c("roe_avg") != 0) & (average != 0), _c("roe_avg") * (1 - average / 100))
    g = F.least(g1, F.coalesce(kept, g1))
    gordon = (g1 < 5) & (uneven < 0.20) & (g < ke)
    flows = [now * F.pow(1 + g1 / 100, F.lit(float(i))) for i in range(1, 6)]
    staged = _present(flows, ke, F.least(F.lit(market.g), ke - 1.0))
    return F.when(F.size(dps) > 2, F.when(gordon, now * (1 + g / 100) / (ke / 100 - g / 100)).otherwise(staged))


def pe_band() -> Column:
    """Median of the years' price-earnings ratios between 0 and 100 (three at least), times the mean of three years' earnings."""
    rows = F.filter("h", lambda r: (r["eps"] > 0) & (r["close"] / r["eps"] > 0) & (r["close"] / r["eps"] < 100))
    ratios = F.array_sort(F.transform(rows, lambda r: r["close"] / r["eps"]))
    eps = F.filter(_last("eps"), lambda x: x > 0)
    normal = F.when(F.size(eps) > 2, _mean(F.slice(eps, 1, 3))).otherwise(F.get(eps, F.lit(0)))
    return F.when(F.size(ratios) > 2, _quantile(ratios, 0.5) * normal)


def peg() -> Column:
    """The price at which the ratio equals the growth of profit, of four years or else five (of five, if that of four is over 80 %)."""
    four, five = _growth(_last("profit", 4)), _growth(_last("profit", 5))
    g = F.when(four > 0, four).otherwise(F.when(five > 0, five))
    g = F.when((g > 80) & (five > 0), five).otherwise(g)
    return F.when(_c("pe") > 0, g * F.coalesce("close", F.lit(0.0)) / _c("pe"))


def ps() -> Column:
    """Median of the years' values by revenue (three at least), times the newest revenue, by share."""
    rows = F.filter("h", lambda r: (r["revenue"] > 0) & (r["close"] > 0))
    ratios = F.array_sort(F.transform(rows, lambda r: r["close"] * _c("shares") / r["revenue"]))
    now = F.get("h", F.lit(0))["revenue"]
    return F.when((now > 0) & (_c("cap") > 0) & (F.size(ratios) > 2), _quantile(ratios, 0.5) * now / _c("shares"))


def implied(market: Market) -> dict[str, Column]:
    """What the price implies: growth by free cash, by earnings and by dividends, and the discount rate at the profit's growth."""
    known = (_c("close") > 0) & (_c("cap") > 0)
    cash = _mean(_free_cash(3))
    by_cash = F.when(known & (cash != 0), cash / _c("cap") * 100)
    dps = F.get(_dividends(), F.lit(0))
    return {
        "implied_g_fcf": _c("wacc") - by_cash,
        "implied_g_earnings": F.when(known & (_c("pe") > 0), _c("ke") - 1 / _c("pe") * 100),
        "implied_g_dividend": F.when(known, (_c("close") * _c("ke") / 100 - dps) / (_c("close") + dps) * 100),
        "implied_wacc": by_cash + _c("profit_growth"),
    }


def run(years: DataFrame, basics: DataFrame, market: str = "A") -> DataFrame:
    """One row a company of ``basics`` that has years: ``code, kind, wacc, ke``, a column for each method (null where the class doesn't use it or data lack), ``methods`` (those that gave a value
    above 0, in order), ``value`` (their mean by weights scaled to those), ``low, high, cv`` (percent), ``agreement`` (high
    below 15, medium below 30, low; none without a value) and the implied rates.
    """
    m = Market.of(market)
    t = by_company(years).join(basics.select("code", "close", "pe", "cap", "shares"), "code")
    t = discounted(classified(t), m)
    make = {"DCF": dcf(m), "DCF_Scenarios": dcf_scenarios(m), "DDM": ddm(m), "PE_Band": pe_band(), "PEG": peg(), "PS": ps()}
    enough = {"DCF": _c("shares") > 0, "DCF_Scenarios": _c("shares") > 0, "PS": _c("shares") > 0}
    used = lambda k: F.array_contains(F.map_keys("weights"), k) & enough.get(k, F.lit(True))
    t = t.withColumns({k: F.when(used(k), make[k]) for k in METHODS} | implied(m))
    values = F.array(*[F.struct(F.lit(k).alias("k"), _c(k).alias("v"), _c("weights")[k].alias("w")) for k in METHODS])
    t = t.withColumn("__v", F.filter(values, lambda x: x["v"] > 0))
    plain = F.transform("__v", lambda x: x["v"])
    weighted = F.aggregate("__v", F.lit(0.0), lambda s, x: s + x["v"] * x["w"])
    cv = F.when(F.size("__v") > 0, F.coalesce(_deviation(plain), F.lit(0.0)) / _mean(plain) * 100)
    t = t.withColumns({"value": F.try_divide(weighted, F.aggregate("__v", F.lit(0.0), lambda s, x: s + x["w"])), "cv": cv, "low": F.array_min(plain), "high": F.array_max(plain)})
    agreement = F.when(_c("cv").isNull(), "none").when(_c("cv") < 15, "high").when(_c("cv") < 30, "medium").otherwise("low")
    return t.select("code", "kind", "wacc", "ke", *METHODS, F.array_join(F.transform("__v", lambda x: x["k"]), ",").alias("methods"), "value", "low", "high", "cv", agreement.alias("agreement"), *implied(m))
