"""Queries of the screening pipeline and the dividend model, on statements out of orders and their lines.

Money is summed in whole cents, so that figures don't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import screener as sc
from quantloom.sources.bars import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_c = F.col

CFG = sc.ScreenConfig(min_turnover=0.2, max_pe=25.0, main_limit=120, obs_limit=30, min_roe=2.0, min_gross_margin=12.0, max_debt_ratio=40.0, min_fcf_years_obs=1)
RF, YEAR = 2.0, 2000


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The columns of a statement: sums over lines of cents ``c``, discount ``d`` and tax ``t`` in percent and quantity ``q``, and a divisor.
_SUMS = {
    "revenue": ("c", 100), "oper_profit": ("c * (10 - d - t)", 10000), "np_parent": ("CASE WHEN l_returnflag = 'R' THEN -c ELSE c END", 1000), "fin_exp": ("c * t", 100000),
    "ocf": ("CASE WHEN l_linestatus = 'F' THEN 3 * c ELSE c END", 1000), "capex": ("CASE WHEN l_returnflag = 'A' THEN 2 * c ELSE 0 END", 1000), "da": ("q", 1),
    "cash": ("CASE WHEN l_linenumber = 1 THEN c ELSE 0 END", 100), "trad": ("CASE WHEN l_linenumber = 2 THEN c ELSE 0 END", 100), "ibd": ("CASE WHEN l_linenumber = 3 THEN c ELSE 0 END", 100),
    "goodwill": ("CASE WHEN l_linenumber = 4 THEN c ELSE 0 END", 1000), "equity": ("c * d", 1000), "total_assets": ("c", 50),
}
#: What a vendor gives for some companies only.
_VENDOR = {"ebitda_v": (3, "c * d", 10000), "netdebt_v": (4, "CASE WHEN l_linenumber = 3 THEN c WHEN l_linenumber = 5 THEN -c ELSE 0 END", 100), "fcff_v": (5, "CASE WHEN l_returnflag = 'N' THEN c ELSE 0 END", 1000)}

STATEMENTS = f"""li AS (SELECT *, round(l_extendedprice * 100)::BIGINT AS c, round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS t, round(l_quantity)::BIGINT AS q FROM lineitem),
 st AS (SELECT o_custkey AS code, year(o_orderdate) AS yr, {", ".join(f"sum({e})::DOUBLE / {n} AS {k}" for k, (e, n) in _SUMS.items())},
  sum(c * (30 - 2 * d))::DOUBLE / sum(c)::DOUBLE AS gross_margin, sum(c * t)::DOUBLE / 100000 AS paid,
  {", ".join(f"CASE WHEN o_custkey % {m} = 0 THEN sum({e})::DOUBLE / {n} END AS {k}" for k, (m, e, n) in _VENDOR.items())}
  FROM li JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)"""


def statements(spark, sf_dir):
    cents = lambda x: F.round(_c(x) * 100).cast("long")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", cents("l_extendedprice").alias("c"), cents("l_discount").alias("d"), cents("l_tax").alias("t"), F.round("l_quantity").cast("long").alias("q")
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", _c("o_custkey").alias("code"), F.year("o_orderdate").alias("yr"))
    total = lambda e: F.sum(F.expr(e)).cast("double")
    t = li.join(o, _c("o_orderkey") == _c("l_orderkey")).groupBy("code", "yr").agg(
        *[(total(e) / n).alias(k) for k, (e, n) in _SUMS.items()], (total("c * (30 - 2 * d)") / total("c")).alias("gross_margin"), (total("c * t") / 100000).alias("paid"), *[(total(e) / n).alias(k) for k, (_, e, n) in _VENDOR.items()]
    )
    return t.withColumns({k: F.when(_c("code") % m == 0, _c(k)) for k, (m, _, _) in _VENDOR.items()})


# Prices by company: a customer's orders.
MARKET = """oc AS (SELECT o_custkey AS code, o_orderpriority, year(o_orderdate) AS yr, round(o_totalprice * 100)::BIGINT AS c FROM orders),
 val AS (SELECT code, sum(c)::DOUBLE / 100 AS total_mv, sum(c)::DOUBLE / count(*) / 1000000 AS close, CASE WHEN count(*) % 6 <> 0 THEN sum(c)::DOUBLE / count(*) / 1000000 END AS pe_ttm,
  (sum(c) % 700)::DOUBLE / 100 AS dv_ttm, count(*)::DOUBLE / 10 AS turnover, min(yr) AS listed, min(c)::DOUBLE / 1000000 AS low FROM oc GROUP BY 1),
 blk AS (SELECT c_custkey AS code, c_mktsegment AS industry, abs(c_acctbal) / 1000 AS pb, total_mv, close, pe_ttm, dv_ttm, turnover, listed FROM customer JOIN val ON code = c_custkey)"""


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(_c("o_custkey").alias("code"), "o_orderpriority", F.year("o_orderdate").alias("yr"), F.round(_c("o_totalprice") * 100).cast("long").alias("c"))


def _valuation(spark, sf_dir):
    s, n = F.sum("c").cast("double"), F.count("*")
    mean = s / n / 1000000
    return _orders(spark, sf_dir).groupBy("code").agg(
        (s / 100).alias("total_mv"), mean.alias("close"), F.when(n % 6 != 0, mean).alias("pe_ttm"), ((F.sum("c") % 700).cast("double") / 100).alias("dv_ttm"), (n.cast("double") / 10).alias("turnover"), F.min("yr").alias("listed")
    )


def _bulk(spark, sf_dir):
    universe = table(spark, sf_dir, "customer").select(_c("c_custkey").alias("code"), _c("c_mktsegment").alias("industry"), (F.abs("c_acctbal") / 1000).alias("pb"))
    return sc.bulk(universe, _valuation(spark, sf_dir))


@query(f"WITH {MARKET} SELECT code, industry, pb, total_mv, close, pe_ttm, dv_ttm, turnover, listed FROM blk")
def t_bulk(spark, sf_dir):
    return _bulk(spark, sf_dir)


_TIER1 = f"""t1 AS (SELECT * FROM blk WHERE (listed IS NULL OR listed <= {YEAR} - {CFG.min_listing_years}) AND total_mv >= {CFG.min_market_cap} AND turnover >= {CFG.min_turnover}::DOUBLE AND pb > 0 AND pb <= {CFG.max_pb}),
 obs AS (SELECT *, 'observation' AS channel FROM t1 WHERE pe_ttm IS NULL ORDER BY total_mv DESC, code LIMIT {CFG.obs_limit}),
 mn AS (SELECT * FROM t1 WHERE pe_ttm > 0 AND pe_ttm <= {CFG.max_pe} AND dv_ttm > 0),
 tops AS (SELECT max(dv_ttm) AS dv, max(1 / pe_ttm) AS pe, max(1 / pb) AS pb FROM mn),
 best AS (SELECT mn.*, 'main' AS channel FROM mn, tops ORDER BY {CFG.dv_weight}::DOUBLE * (dv_ttm / dv) + {CFG.pe_weight}::DOUBLE * (1 / pe_ttm / pe) + {CFG.pb_weight}::DOUBLE * (1 / mn.pb / tops.pb) DESC, code LIMIT {CFG.main_limit}),
 picked AS (SELECT * FROM best UNION ALL SELECT * FROM obs)"""


@query(f"WITH {MARKET}, {_TIER1} SELECT code, channel, total_mv FROM picked")
def t_first(spark, sf_dir):
    return sc.first_tier(_bulk(spark, sf_dir), CFG, F.lit(YEAR)).select("code", "channel", "total_mv")


_LATEST = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY yr DESC) AS r FROM st),
 ls AS (SELECT code, {", ".join(f"max({k}) FILTER (r = 1) AS {k}" for k in sc.STATEMENT)}, count(ocf - capex) AS fcf_years, count(*) FILTER (ocf - capex > 0) AS fcf_good, count(*) FILTER (ocf - abs(capex) > 0) AS fcf_good_abs, min(ocf - capex) AS fcf_min FROM rk WHERE r <= 5 GROUP BY 1)"""
_EBITDA, _DEBT = "coalesce(ebitda_v, oper_profit + coalesce(fin_exp, 0) + coalesce(da, 0))", "coalesce(netdebt_v, coalesce(ibd, 0) - coalesce(cash, 0))"
_OWN = "(coalesce(ocf, 0) - coalesce(capex, 0))"
_POS = lambda e: f"(CASE WHEN {e} > 0 THEN {e} END)"
_F4 = {
    "ev_ebitda": f"(total_mv + {_DEBT}) / {_POS(_EBITDA)}", "net_debt_ebitda": f"{_DEBT} / {_POS(_EBITDA)}", "fcf_yield": f"coalesce(fcff_v, {_OWN}) / {_POS('total_mv')} * 100", "fcf_margin": f"{_OWN} / {_POS('revenue')} * 100",
    "fcf_consistency": f"fcf_good / {_POS('fcf_years')}", "goodwill_ratio": f"coalesce(goodwill, 0) / {_POS('total_assets')} * 100", "cash_adj_pe": f"(total_mv + {_DEBT}) / {_POS('np_parent')}",
}


@query(f"WITH {MARKET}, {STATEMENTS}, {_LATEST} SELECT code, {', '.join(f'round({e}, 6) AS {k}' for k, e in _F4.items())} FROM blk LEFT JOIN ls USING (code)")
def t_factor4(spark, sf_dir):
    t = _bulk(spark, sf_dir).join(sc.latest_statements(statements(spark, sf_dir)), "code", "left")
    return sc.valuation_metrics(t).select("code", *[F.round(k, 6).alias(k) for k in _F4])


# Pledges and audits: the share of urgent orders and whether the company's books balance; dividends: urgent orders by year.
_SIDES = """vt AS (SELECT code, 100 * (count(*) FILTER (o_orderpriority = '1-URGENT'))::DOUBLE / count(*) AS pledge, sum(c) % 11 <> 0 AS clean FROM oc GROUP BY 1),
 dy AS (SELECT code, yr, sum(c)::DOUBLE / 1000000000 AS dps FROM oc WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2),
 d3 AS (SELECT code, list_sum(xs[1:3]) / len(xs[1:3]) AS dps3 FROM (SELECT code, list(dps ORDER BY yr DESC) AS xs FROM dy GROUP BY 1)),
 dv AS (SELECT code, low, dps3 FROM val LEFT JOIN d3 USING (code))"""


def _vetoes(spark, sf_dir):
    pledge = 100 * F.count_if(_c("o_orderpriority") == "1-URGENT").cast("double") / F.count("*")
    return _orders(spark, sf_dir).groupBy("code").agg(pledge.alias("pledge"), (F.sum("c") % 11 != 0).alias("clean"))


def _dps(spark, sf_dir):
    return _orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'").groupBy("code", "yr").agg((F.sum("c").cast("double") / 1000000000).alias("dps"))


def _dividends(spark, sf_dir):
    newest = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("yr", "dps")))), 1, 3)["dps"]  # a year each: short lists
    d3 = _dps(spark, sf_dir).groupBy("code").agg(newest.alias("xs"))
    d3 = d3.select("code", (F.aggregate("xs", F.lit(0.0), lambda s, x: s + x) / F.size("xs")).alias("dps3"))
    low = _orders(spark, sf_dir).groupBy("code").agg((F.min("c").cast("double") / 1000000).alias("low"))
    return low.join(d3, "code", "left")


def _second(spark, sf_dir):
    first = sc.first_tier(_bulk(spark, sf_dir), CFG, F.lit(YEAR))
    return sc.second_tier(first, statements(spark, sf_dir), _vetoes(spark, sf_dir), _dividends(spark, sf_dir), RF, CFG)


_SH = "(total_mv / (CASE WHEN close > 0 THEN close END))"
_FLOORS = ", ".join([f"(coalesce(cash, 0) + coalesce(trad, 0) - coalesce(ibd, 0)) / {_SH}", f"coalesce(equity, 0) / {_SH}", "low", f"dps3 / {max(RF / 100, 0.03)}::DOUBLE", f"CASE WHEN fcf_min > 0 THEN fcf_min / {RF / 100}::DOUBLE / {_SH} END"])
_ROE, _RATIO = f"np_parent / {_POS('equity')} * 100", f"ibd / {_POS('total_assets')} * 100"
_ABS = "(coalesce(ocf, 0) - abs(coalesce(capex, 0)))"
_SINGLE = f"""{MARKET}, {_TIER1}, {STATEMENTS}, {_LATEST}, {_SIDES},
 al AS (SELECT * FROM picked LEFT JOIN ls USING (code) LEFT JOIN vt USING (code) LEFT JOIN dv USING (code)),
 ok AS (SELECT * FROM al WHERE coalesce(pledge <= {CFG.max_pledge}, true) AND coalesce(clean, true) AND coalesce({_ROE} >= CASE WHEN channel = 'main' THEN {CFG.min_roe} ELSE {CFG.min_roe_obs} END, true)
  AND coalesce(gross_margin >= {CFG.min_gross_margin}, true) AND coalesce({_RATIO} <= {CFG.max_debt_ratio}, true)
  AND (channel = 'main' OR coalesce(ocf > 0 AND {_ABS} / {_POS("revenue")} * 100 >= {CFG.min_fcf_margin_obs} AND fcf_good_abs >= {CFG.min_fcf_years_obs}, false))),
 me AS (SELECT code, channel, {", ".join(f"{e} AS {k}" for k, e in _F4.items() if k != "cash_adj_pe")}, {_ROE} AS roe, close,
  {_ABS} * least(CASE WHEN np_parent > 0 AND dps3 IS NOT NULL THEN dps3 * {_SH} / np_parent ELSE 1 END, 1) / {_POS("total_mv")} * 100 AS r,
  list_sum(list_filter([{_FLOORS}], lambda x: x IS NOT NULL)) / len(list_filter([{_FLOORS}], lambda x: x IS NOT NULL)) AS floor FROM ok),
 mp AS (SELECT *, (close / {_POS("floor")} - 1) * 100 AS premium FROM me)"""
_COLUMNS = ["roe", "r", "ev_ebitda", "fcf_yield", "net_debt_ebitda", "goodwill_ratio", "fcf_consistency", "fcf_margin", "floor", "premium"]


@query(f"WITH {_SINGLE} SELECT code, channel, {', '.join(f'round({k}, 6) AS {k}' for k in _COLUMNS)} FROM mp")
def t_single(spark, sf_dir):
    return _second(spark, sf_dir).select("code", "channel", *[F.round(k, 6).alias(k) for k in _COLUMNS])


_PCT = lambda x, nulls: f"((rank() OVER (ORDER BY {x} NULLS {nulls}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE) / count(*) OVER ())"
_UP = " + ".join(f"{w}::DOUBLE * {_PCT(x, 'LAST')}" for x, w in (("roe", CFG.weight_roe), ("fcf_yield", CFG.weight_fcf_yield), ("r", CFG.weight_r)))
_DOWN = " + ".join(f"{w}::DOUBLE * (1 - {_PCT(x, 'FIRST')})" for x, w in (("ev_ebitda", CFG.weight_ev), ("premium", CFG.weight_premium)))


@query(f"WITH {_SINGLE} SELECT code, channel, round({_UP} + {_DOWN}, 7) AS score FROM mp")
def t_run(spark, sf_dir):
    return _second(spark, sf_dir).select("code", "channel", F.round("score", 7).alias("score"))


_DPS = f"""{MARKET}, {STATEMENTS}, {_SIDES}, sh AS (SELECT code, total_mv / close / 1000 AS shares FROM val),
 pd AS (SELECT code, yr, paid, shares, np_parent, equity FROM st JOIN sh USING (code)),
 ad AS (SELECT * FROM (SELECT dy.code, dy.yr, CASE WHEN dps * shares / {_POS("paid")} > 0 AND dps * shares / {_POS("paid")} < 0.5::DOUBLE THEN paid / shares ELSE dps END AS dps, np_parent, equity, shares FROM dy LEFT JOIN pd USING (code, yr)) WHERE dps > 0)"""


def _paid(spark, sf_dir):
    shares = _valuation(spark, sf_dir).select("code", (_c("total_mv") / _c("close") / 1000).alias("shares"))
    return statements(spark, sf_dir).select("code", "yr", "paid", "np_parent", "equity").join(shares, "code")


@query(f"WITH {_DPS} SELECT code, yr, round(dps, 8) AS dps FROM ad")
def v_dps(spark, sf_dir):
    t = sc.annual_dps(_dps(spark, sf_dir), _paid(spark, sf_dir).select("code", "yr", "paid", "shares"))
    return t.select("code", "yr", F.round("dps", 8).alias("dps"))


KE, TERMINAL = 9.0, 3.0
_G2 = min(TERMINAL, KE - 1)
_CV = "coalesce(coalesce(payout_sd, 0) / (CASE WHEN payout_avg > 0 THEN payout_avg END), 0)"
_G1 = "coalesce(cagr, 2)"
_G = f"least({_G1}, coalesce(CASE WHEN roe <> 0 AND payout_avg <> 0 THEN roe * (1 - payout_avg / 100) END, {_G1}))"
_GORDON = f"({_G1} < 5 AND {_CV} < 0.2::DOUBLE AND {_G} < {KE})"
_TWO = " + ".join(f"dps * pow(1 + {_G1} / 100, {i}) / pow({1 + KE / 100}::DOUBLE, {i})" for i in range(1, 6)) + f" + dps * pow(1 + {_G1} / 100, 5) * {1 + _G2 / 100}::DOUBLE / {KE / 100 - _G2 / 100}::DOUBLE / pow({1 + KE / 100}::DOUBLE, 5)"


@query(f"""WITH {_DPS}, o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY yr DESC) AS k, CASE WHEN np_parent > 0 THEN dps * shares / np_parent * 100 END AS payout, np_parent / {_POS("equity")} * 100 AS roe1 FROM ad),
 m AS (SELECT code, count(*) AS n, arg_max(dps, yr) AS dps, CASE WHEN count(*) > 1 THEN (pow(arg_max(dps, yr) / arg_min(dps, yr), 1.0::DOUBLE / (count(*) - 1)) - 1) * 100 END AS cagr,
  avg(payout) FILTER (k <= 3) AS payout_avg, stddev_samp(payout) FILTER (k <= 3) AS payout_sd, avg(roe1) FILTER (k <= 5) AS roe FROM o GROUP BY 1)
 SELECT code, CASE WHEN n >= 3 THEN CASE WHEN {_GORDON} THEN 'Gordon' ELSE 'Two-stage' END END AS model, round(CASE WHEN n >= 3 THEN CASE WHEN {_GORDON} THEN dps * (1 + {_G} / 100) / ({KE / 100}::DOUBLE - {_G} / 100) ELSE {_TWO} END END, 7) AS value FROM m""")
def v_ddm_choice(spark, sf_dir):
    """The dividend model that a company's record asks for, and its value."""
    paid = _paid(spark, sf_dir)
    t = sc.annual_dps(_dps(spark, sf_dir), paid.select("code", "yr", "paid", "shares")).join(paid.drop("paid"), ["code", "yr"], "left")
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("yr"))))
    payout = F.when(_c("np_parent") > 0, _c("dps") * _c("shares") / _c("np_parent") * 100)
    roe = _c("np_parent") / F.when(_c("equity") > 0, _c("equity")) * 100
    last, first = F.max_by("dps", "yr"), F.min_by("dps", "yr")
    cagr = F.when(F.count("*") > 1, (F.pow(last / first, F.try_divide(F.lit(1.0), F.count("*") - 1)) - 1) * 100)
    three = lambda x: F.when(_c("k") <= 3, x)
    t = t.groupBy("code").agg(F.count("*").alias("n"), last.alias("dps"), cagr.alias("cagr"), F.avg(three(payout)).alias("payout_avg"), F.stddev_samp(three(payout)).alias("payout_sd"), F.avg(F.when(_c("k") <= 5, roe)).alias("roe"))
    m = sc.dividend_model(KE, TERMINAL)
    return t.select("code", m["model"].alias("model"), F.round(m["value"], 7).alias("value"))
