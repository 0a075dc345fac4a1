"""The whole valuation on yearly statements derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import valuation as va
from quantloom.sources.bars import table

from .q_surplus import STATEMENTS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_c = F.col


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def years(spark, sf_dir):
    """Statements in whole money: profit below 0 in small years, cash flows, dividends and prices missing in some."""
    t = table(spark, sf_dir, "orders").select(_c("o_custkey").alias("code"), F.year("o_orderdate").alias("yr"), F.round("o_totalprice").cast("long").alias("v"), _c("o_orderstatus").alias("s"), _c("o_orderpriority").alias("p"))
    of = lambda cond: F.sum(F.when(cond, _c("v")))
    t = t.groupBy("code", "yr").agg(
        F.sum("v").alias("revenue"), of(_c("s") != "P").alias("tcr"), of(_c("p") < "4").alias("w"), of(_c("p") == "5-LOW").alias("low"), of(_c("s") == "O").alias("paid"), of(_c("s") == "F").alias("held")
    )
    profit = (_c("revenue") - 90000) / 8
    return t.select(
        "code", "yr", _c("revenue").cast("double").alias("revenue"), profit.alias("profit"), (profit / 1e5).alias("eps"), (_c("held") / _c("revenue") * 40).alias("roe"), (_c("paid") / _c("revenue") * 60).alias("payout"),
        (_c("tcr") / 5).alias("ocf"), (_c("low") / -10).alias("capex"), (_c("revenue") / 50).alias("da"), (profit * 0.2).alias("tax"), profit.alias("pre_tax"), (_c("w") / 200).alias("finance_exp"), (_c("w") / 4).alias("debt"),
        (_c("revenue") / 10).alias("cash"), F.when(_c("tcr").isNotNull(), _c("revenue") / 1e4).alias("close"), (_c("held") / 1e6).alias("dps"),
    )


def basics(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(_c("c_custkey").alias("code"), (_c("c_acctbal") / 100).alias("close"))
    pe = F.when(_c("code") % 40 != 7, (_c("code") % 40).cast("double") - 3)
    return t.select("code", "close", pe.alias("pe"), ((_c("code") % 9).cast("double") * 1e5).alias("cap"), F.lit(1e5).alias("shares"))


_HY = """vy AS (SELECT code, yr, revenue::DOUBLE AS revenue, (revenue - 90000) / 8 AS profit, held / revenue * 40 AS roe, paid / revenue * 60 AS payout, CASE WHEN tcr IS NOT NULL AND low IS NOT NULL THEN tcr / 5 - abs(low / 10) END AS fcf,
        coalesce(low / 10, 0) AS capex, revenue / 50 AS da, w / 200 AS finance_exp, w / 4 AS debt, revenue / 10 AS cash, CASE WHEN tcr IS NOT NULL THEN revenue / 1e4::DOUBLE END AS close, held / 1e6::DOUBLE AS dps
    FROM (SELECT *, capex AS low FROM sv)),
vz AS (SELECT *, profit / 1e5::DOUBLE AS eps FROM vy),
vh AS (SELECT code, """ + ", ".join(f"list({f} ORDER BY yr DESC) AS {f}" for f in "revenue profit eps roe payout fcf capex da finance_exp debt cash dps".split()) + """,
        list(CASE WHEN profit > 0 THEN profit * 0.2::DOUBLE / profit * 100 END ORDER BY yr DESC) AS taxes,
        list(CASE WHEN eps > 0 AND close / eps > 0 AND close / eps < 100 THEN close / eps END ORDER BY yr DESC) AS pes, list(CASE WHEN close > 0 THEN close / revenue END ORDER BY yr DESC) AS pss FROM vz GROUP BY 1),
vb AS (SELECT c_custkey AS code, c_acctbal / 100 AS price, CASE WHEN c_custkey % 40 <> 7 THEN c_custkey % 40 - 3 END::DOUBLE AS pe, (c_custkey % 9) * 1e5::DOUBLE AS cap, 1e5::DOUBLE AS shares FROM customer)"""


def _there(x: str) -> str:
    return f"list_filter({x}, lambda x: x IS NOT NULL)"


def _positive(x: str) -> str:
    return f"list_filter({x}, lambda x: x > 0)"


def _growth(x: str) -> str:
    p = _positive(x)
    return f"CASE WHEN len({p}) > 1 THEN (pow({p}[1] / {p}[len({p})], 1.0::DOUBLE / (len({p}) - 1)) - 1) * 100 END"


def _present(flows: list[str], rate: str, g: str, floor: bool = False) -> str:
    after = f"{flows[-1]} * (1 + {g} / 100) / ({rate} / 100 - {g} / 100)"
    if floor:
        after = f"CASE WHEN {flows[-1]} > 0 THEN {after} ELSE 0 END"
    return " + ".join(f"{f} / pow(1 + {rate} / 100, {i})" for i, f in enumerate(flows, 1)) + f" + ({after}) / pow(1 + {rate} / 100, 5)"


def _grown(first: str, rates: list[str]) -> list[str]:
    out, f = [], f"({first})"
    for r in rates:
        f = f"{f} * (1 + ({r}) / 100)"
        out.append(f)
    return out


def _scenario(shares: list[float], drift: float, capex: float) -> str:
    sold = _grown("revenue[1]", [f"rg10 * {s}::DOUBLE" for s in shares])
    flows = [f"({s} * (margin + {drift}::DOUBLE * {i}) / 100 + da[1] - {s} * spending * {capex}::DOUBLE)" for i, s in enumerate(sold, 1)]
    return f"(({_present(flows, 'wacc', 'gt', floor=True)}) + cash[1] - debt1) / shares"


_USED = {"DCF": "kind <> 'growth'", "DCF_Scenarios": "kind = 'growth'", "DDM": "kind = 'blue' OR (kind = 'mixed' AND NOT frugal)", "PE_Band": "kind <> 'growth'", "PEG": "kind <> 'blue'", "PS": "kind = 'growth'"}
_W = {
    "DCF": "CASE WHEN kind = 'blue' THEN 40 WHEN frugal THEN 40 ELSE 35 END", "DCF_Scenarios": "35", "DDM": "CASE WHEN kind = 'blue' THEN 30 ELSE 15 END",
    "PE_Band": "CASE WHEN kind = 'blue' THEN 30 WHEN frugal THEN 30 ELSE 25 END", "PEG": "CASE WHEN kind = 'growth' THEN 35 WHEN frugal THEN 30 ELSE 25 END", "PS": "30",
}
_FLOWS = _there("fcf[1:5]")
_DIVS = _positive("dps")
_PAID = _there("payout") + "[1:3]"
_VALUES = {
    "DCF": f"CASE WHEN len({_FLOWS}) > 1 THEN (({_present(_grown('base', ['g1', 'g1', '(g1 + gt) / 2', '((g1 + gt) / 2 + gt) / 2', 'gt']), 'wacc', 'gt')}) + cash[1] - debt1) / shares END",
    "DCF_Scenarios": f"0.25::DOUBLE * {_scenario([1.0] * 5, 0.5, 1.0)} + 0.5::DOUBLE * {_scenario([0.7] * 5, 0.0, 1.0)} + 0.25::DOUBLE * {_scenario([0.4, 0.4, 0, 0, 0], -0.3, 1.2)}",
    "DDM": f"CASE WHEN len({_DIVS}) > 2 THEN CASE WHEN dg < 5 AND uneven < 0.2::DOUBLE AND least(dg, coalesce(keptg, dg)) < ke THEN d1 * (1 + least(dg, coalesce(keptg, dg)) / 100) / (ke / 100 - least(dg, coalesce(keptg, dg)) / 100) ELSE {_present(_grown('d1', ['dg'] * 5), 'ke', 'least(3.0::DOUBLE, ke - 1)')} END END",
    "PE_Band": f"CASE WHEN len({_there('pes')}) > 2 THEN list_median({_there('pes')}) * CASE WHEN len({_positive('eps')}) > 2 THEN list_avg({_positive('eps')}[1:3]) ELSE {_positive('eps')}[1] END END",
    "PEG": "CASE WHEN pe > 0 THEN (CASE WHEN p4 > 0 THEN CASE WHEN p4 > 80 AND p5 > 0 THEN p5 ELSE p4 END WHEN p5 > 0 THEN p5 END) * coalesce(price, 0) / pe END",
    "PS": f"CASE WHEN revenue[1] > 0 AND cap > 0 AND len({_there('pss')}) > 2 THEN list_median({_there('pss')}) * shares * revenue[1] / shares END",
}

_SQL = f"""WITH {STATEMENTS}, {_HY},
    k1 AS (SELECT *, list_avg({_there('roe[1:5]')}) AS roe_avg, list_avg({_there('payout[1:3]')}) AS payout_avg, {_growth('revenue[1:5]')} AS rg, {_growth('profit[1:5]')} AS p5, {_growth('profit[1:4]')} AS p4 FROM vh JOIN vb USING (code)),
    k2 AS (SELECT *, coalesce(roe_avg > 15, false)::INT + coalesce(payout_avg > 30, false)::INT + coalesce(rg < 20, false)::INT AS blue, coalesce(rg > 20, false)::INT + coalesce(p5 > 25, false)::INT AS growth FROM k1),
    k3 AS (SELECT *, CASE WHEN profit[1] < 0 THEN 'growth' WHEN blue >= 2 AND growth = 0 THEN 'blue' WHEN growth >= 2 AND blue <= 1 THEN 'growth' ELSE 'mixed' END AS kind, coalesce(debt[1], 0) AS debt1 FROM k2),
    k4 AS (SELECT *, kind = 'mixed' AND coalesce(payout_avg <= 20, false) AS frugal, 2.5::DOUBLE + CASE WHEN cap / 1e6 > 1000000 THEN 0.8::DOUBLE WHEN cap / 1e6 > 100000 THEN 1.0::DOUBLE WHEN cap > 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * 6 AS ke,
        (debt1 + coalesce(debt[2], 0)) / 2 AS debt2, coalesce(list_avg({_there('taxes[1:5]')}), 25) AS tax FROM k3),
    k5 AS (SELECT *, CASE WHEN debt1 > 0 THEN ke * cap / (cap + debt1) + (CASE WHEN finance_exp[1] > 0 AND debt2 > 0 THEN finance_exp[1] / debt2 * 100 ELSE 3.5::DOUBLE END) * (1 - tax / 100) * debt1 / (cap + debt1) ELSE ke END AS wacc FROM k4),
    k6 AS (SELECT *, CASE WHEN wacc <= 3 THEN wacc - 2 ELSE 3 END AS gt, list_avg({_FLOWS}[1:3]) AS base, 0.8::DOUBLE * (CASE WHEN {_growth(_FLOWS)} > 0 THEN {_growth(_FLOWS)} ELSE coalesce(rg, 5) END) AS g1, coalesce(rg, 10) AS rg10,
        CASE WHEN revenue[1] > 0 THEN profit[1] / revenue[1] * 100 ELSE 5 END AS margin, CASE WHEN revenue[1] > 0 THEN capex[1] / revenue[1] ELSE 0.05::DOUBLE END AS spending,
        {_DIVS}[1] AS d1, coalesce({_growth(_DIVS)}, 2) AS dg, list_avg({_PAID}) AS pavg, CASE WHEN list_avg({_PAID}) > 0 THEN coalesce(CASE WHEN len({_PAID}) > 1 THEN list_stddev_samp({_PAID}) END, 0) / list_avg({_PAID}) ELSE 0 END AS uneven,
        CASE WHEN price > 0 AND cap > 0 AND list_avg({_there('fcf[1:3]')}) <> 0 THEN list_avg({_there('fcf[1:3]')}) / cap * 100 END AS fy FROM k5),
    k7 AS (SELECT *, CASE WHEN roe_avg <> 0 AND pavg <> 0 THEN roe_avg * (1 - pavg / 100) END AS keptg FROM k6),
    k8 AS (SELECT *, {", ".join(f'CASE WHEN {_USED[k]} THEN {v} END AS "{k}"' for k, v in _VALUES.items())} FROM k7),
    k9 AS (SELECT *, list_filter([{", ".join(f"{{'k': '{k}', 'v': {k}::DOUBLE, 'w': ({_W[k]})::DOUBLE}}" for k in _VALUES)}], lambda x: x.v > 0) AS vs FROM k8),
    k10 AS (SELECT *, list_transform(vs, lambda x: x.v) AS plain FROM k9),
    k11 AS (SELECT *, CASE WHEN len(vs) > 0 THEN CASE WHEN len(vs) > 1 THEN list_stddev_samp(plain) ELSE 0 END / list_avg(plain) * 100 END AS cv FROM k10)
    SELECT code, kind, round(wacc, 6) AS wacc, round(ke, 6) AS ke, {", ".join(f'round({k}, 4) AS "{k}"' for k in _VALUES)}, array_to_string(list_transform(vs, lambda x: x.k), ',') AS methods,
        round(list_sum(list_transform(vs, lambda x: x.v * x.w)) / list_sum(list_transform(vs, lambda x: x.w)), 4) AS value, round(list_min(plain), 4) AS low, round(list_max(plain), 4) AS high, round(cv, 4) AS cv,
        CASE WHEN cv IS NULL THEN 'none' WHEN cv < 15 THEN 'high' WHEN cv < 30 THEN 'medium' ELSE 'low' END AS agreement, round(wacc - fy, 5) AS implied_g_fcf,
        round(CASE WHEN price > 0 AND cap > 0 AND pe > 0 THEN ke - 1 / pe * 100 END, 6) AS implied_g_earnings, round(CASE WHEN price > 0 AND cap > 0 THEN (price * ke / 100 - d1) / (price + d1) * 100 END, 6) AS implied_g_dividend, round(fy + p5, 5) AS implied_wacc FROM k11"""


@query(_SQL)
def v_run(spark, sf_dir):
    t = va.run(years(spark, sf_dir), basics(spark, sf_dir))
    digits = {"implied_g_fcf": 5, "implied_wacc": 5, "wacc": 6, "ke": 6, "implied_g_earnings": 6, "implied_g_dividend": 6}
    return t.select(*[F.round(c, digits.get(c, 4)).alias(c) if k == "double" else _c(c) for c, k in t.dtypes])
