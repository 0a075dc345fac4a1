"""Queries of yearly tables, dashboards, ranges and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import scalar as sc
from quantloom.operators import derived as dv
from quantloom.operators import relational as rel
from quantloom.operators import reports as rp
from quantloom.sources.bars import BARS, SNAPSHOT, customer_snapshot, table, weekly_brand_bars

from .q_models import _YEAR, _quarters
from .q_valuation import _HY, STATEMENTS, basics, years

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


def _rounded(df, digits: int = 5):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else _c(c) for c, t in df.dtypes])


def _r(digits: int = 5, **columns: str) -> str:
    return ", ".join(f"round(({v})::DOUBLE, {digits}) AS {k}" for k, v in columns.items())


def _statements(spark, sf_dir):
    """The yearly statements with further items."""
    t = years(spark, sf_dir)
    more = {"assets": _c("revenue") * 2, "tradable": _c("cash") / 3, "equity": _c("revenue") / 2, "goodwill": _c("debt") / 9, "operating": _c("profit") * 1.1, "minority": _c("profit") / 17, "n_income": _c("profit") * 1.05}
    return t.withColumns(more)


_S = f"{STATEMENTS}, {_HY}, rs AS (SELECT vz.*, low / -10 AS cx, CASE WHEN tcr IS NOT NULL THEN tcr / 5 END AS ocf, revenue * 2 AS assets, row_number() OVER (PARTITION BY code ORDER BY yr DESC) AS r FROM vz JOIN (SELECT code, yr, capex AS low, tcr FROM sv) USING (code, yr))"
_G = "CASE WHEN count(*) FILTER ({0} > 0) OVER k > 1 THEN (pow(arg_max({0}, yr) FILTER ({0} > 0) OVER k / arg_min({0}, yr) FILTER ({0} > 0) OVER k, 1.0::DOUBLE / (count(*) FILTER ({0} > 0) OVER k - 1)) - 1) * 100 END"


@query(f"""WITH {_S} SELECT code, yr, {_r(revenue='revenue', profit='profit', debt='debt', debt_ratio='CASE WHEN assets > 0 THEN debt / assets * 100 END', net_cash='cash - debt', payout='payout', revenue_cagr=_G.format('revenue'), profit_cagr=_G.format('profit'))}
    FROM rs WINDOW k AS (PARTITION BY code) QUALIFY count(*) OVER (PARTITION BY code) > 1""")
def m_trends(spark, sf_dir):
    return _rounded(rp.trends(_statements(spark, sf_dir)))


@query(f"""WITH {_S} SELECT code, {_r(c='max(profit) FILTER (r = 1)', minority_share='max(CASE WHEN profit <> 0 THEN profit / 17 / (profit * 1.05::DOUBLE) * 100 END) FILTER (r = 1)', fcf='max(ocf - abs(cx)) FILTER (r = 1)', f='median(CASE WHEN da > 0 THEN abs(cx) / da END)',
    m='avg(payout) FILTER (r <= 3)', n='CASE WHEN count(payout) FILTER (r <= 3) > 1 THEN stddev_samp(payout) FILTER (r <= 3) WHEN count(payout) FILTER (r <= 3) = 1 THEN 0 END', ii='greatest(5.0, 2.5 + 3.0)')} FROM rs GROUP BY 1""")
def m_factor2(spark, sf_dir):
    return _rounded(rp.owner_inputs(_statements(spark, sf_dir), 2.5, "HK"))


@query(f"""WITH {_S}, p AS (SELECT code, coalesce(debt, 0) AS gd, coalesce(cash, 0) AS gc, coalesce(debt * 0.4::DOUBLE, 0) AS pd, coalesce(cash * 0.3::DOUBLE, 0) AS pc FROM rs WHERE r = 1)
    SELECT code, {_r(group_debt='gd', group_cash='gc', parent_debt='pd', parent_cash='pc', group_net='gc - gd', parent_net='pc - pd', subsidiary_share='CASE WHEN gd > 0 THEN (gd - pd) / gd * 100 END')} FROM p""")
def m_sotp(spark, sf_dir):
    t = _statements(spark, sf_dir)
    return _rounded(rp.holding_structure(t, t.withColumns({"debt": _c("debt") * 0.4, "cash": _c("cash") * 0.3})))


_FLOORS = {
    "floor_liquid": "(cash + cash / 3 - debt) / shares", "floor_equity": "equity / shares", "floor_low": "low", "floor_dividend": "mean_dps / 0.03::DOUBLE", "floor_cash": "CASE WHEN least_fcf > 0 THEN least_fcf / 0.02::DOUBLE / shares END",
}


@query(f"""WITH {_S}, d AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dps IS NULL, yr DESC) AS dr FROM rs),
    a AS (SELECT code, max(cash) FILTER (r = 1) AS cash, coalesce(max(debt) FILTER (r = 1), 0) AS debt, max(revenue / 2) FILTER (r = 1) AS equity, max(assets) FILTER (r = 1) AS assets, max(profit) FILTER (r = 1) AS profit,
        max(profit * 1.1::DOUBLE + coalesce(finance_exp, 0) + da) FILTER (r = 1) AS ebitda, max(coalesce(ocf, 0) - coalesce(cx, 0)) FILTER (r = 1) AS fcf, min(ocf - cx) AS least_fcf, avg(dps) FILTER (dr <= 3) AS mean_dps, max(dps) FILTER (dr = 1) AS dps, min(close) AS low FROM d GROUP BY 1),
    b AS (SELECT *, price AS close, cap + debt - cash AS ev, debt - cash AS net_debt FROM a JOIN vb USING (code) WHERE price > 0 AND cap > 0),
    f AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _FLOORS.items())} FROM b), g AS (SELECT *, list_filter([{", ".join(_FLOORS)}], lambda x: x IS NOT NULL) AS fl FROM f),
    h AS (SELECT *, len(fl) AS n_floors, list_sum(fl) / len(fl) AS floor FROM g), i AS (SELECT *, close / nullif(floor, 0) * 100 - 100 AS premium FROM h)
    SELECT code, {_r(7, ev='ev', ebitda='ebitda', ev_ebitda='CASE WHEN ebitda > 0 THEN ev / ebitda END', cash_pe='CASE WHEN profit > 0 THEN (cap + net_debt) / profit END', fcf_yield='fcf / cap * 100', pb='CASE WHEN equity > 0 THEN cap / equity END',
        net_debt_ebitda='CASE WHEN ebitda > 0 THEN net_debt / ebitda END', goodwill_ratio='debt / 9 / assets * 100', debt_ratio='debt / assets * 100', dividend_yield='dps / close * 100', **{k: k for k in _FLOORS}, floor='floor', premium='premium')}, n_floors::INT AS n_floors,
        CASE WHEN premium IS NULL THEN NULL WHEN premium <= 0 THEN 'below_floor' WHEN premium <= 30 THEN 'near' WHEN premium <= 80 THEN 'fair' WHEN premium <= 150 THEN 'high' ELSE 'extreme' END AS verdict FROM i""")
def m_ev(spark, sf_dir):
    t = _statements(spark, sf_dir)
    return _rounded(rp.value_dashboard(t, basics(spark, sf_dir), t.groupBy("code").agg(F.min("close").alias("low")), 2.0), 7)


@query("WITH x AS (SELECT c_custkey AS code, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 2000 END AS rf, CASE c_custkey % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'HK' ELSE 'US' END AS m FROM customer) SELECT code, CASE WHEN rf IS NOT NULL THEN CASE m WHEN 'HK' THEN greatest(5, rf + 3) WHEN 'US' THEN greatest(4, rf + 2) ELSE greatest(3.5, rf + 2) END END::DOUBLE AS ii FROM x")
def m_rf_ii(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(_c("c_custkey").alias("code"), F.when(_c("c_custkey") % 7 != 0, _c("c_acctbal") / 2000).alias("rf"))
    market = F.when(_c("code") % 3 == 0, "CN").when(_c("code") % 3 == 1, "HK").otherwise("US")
    return t.select("code", rp.threshold(_c("rf"), market).alias("ii"))


# --- ranges ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {BARS}, t AS (SELECT * FROM bars QUALIFY trade_date >= max(trade_date) OVER (PARTITION BY symbol) - 365), a AS (SELECT symbol, max(high) AS high, arg_max(trade_date, (high, trade_date)) AS hd, min(low) AS low, arg_min(trade_date, (low, -epoch(trade_date))) AS ld, arg_max(close, trade_date) AS close, avg(volume) AS v FROM t GROUP BY 1)
    SELECT symbol, high, hd::VARCHAR AS high_date, low, ld::VARCHAR AS low_date, {_r(6, close='close', mean_volume='v', rise='(close / low - 1) * 100')} FROM a""")
def f_range52(spark, sf_dir):
    t = rp.year_range(weekly_brand_bars(spark, sf_dir))
    return t.select("symbol", "high", "high_date", "low", "low_date", *[F.round(c, 6).alias(c) for c in ("close", "mean_volume", "rise")])


@query(f"""WITH {BARS}, a AS (SELECT symbol, max(high) AS sh, arg_max(trade_date, (high, -epoch(trade_date))) AS hd, min(low) AS sl, arg_min(trade_date, (low, epoch(trade_date))) AS ld, arg_max(close, trade_date) AS last FROM bars GROUP BY 1)
    SELECT b.symbol, year(trade_date)::INT AS year, max(high) AS high, min(low) AS low, {_r(6, close='arg_max(close, trade_date)', mean_volume='avg(volume)', fall='(1 - any_value(last) / any_value(sh)) * 100', rise='(any_value(last) / any_value(sl) - 1) * 100')}, any_value(sh) AS span_high, any_value(hd)::VARCHAR AS high_date, any_value(sl) AS span_low, any_value(ld)::VARCHAR AS low_date
    FROM bars b JOIN a USING (symbol) GROUP BY 1, 2""")
def f_range10y(spark, sf_dir):
    t = rp.ten_years(weekly_brand_bars(spark, sf_dir))
    return t.select(*[F.round(c, 6).alias(c) if c in ("close", "mean_volume", "fall", "rise") else _c(c) for c in t.columns])


# --- tables ----------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT o_custkey AS code, date_trunc('month', o_orderdate)::DATE AS end_date, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderkey) = 1)
    SELECT code, end_date::VARCHAR AS end_date, o_orderkey, o_totalprice FROM t QUALIFY dense_rank() OVER (PARTITION BY code ORDER BY year(end_date) DESC) <= 5""")
def f_dividends(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(_c("o_custkey").alias("code"), F.trunc("o_orderdate", "month").alias("end_date"), F.when(_c("o_orderstatus") == "F", "done").alias("status"), "o_orderkey", "o_totalprice")
    return rp.paid_dividends(t, [_c("o_orderkey")]).drop("status")


@query("""WITH t AS (SELECT l_partkey AS code, date_trunc('quarter', l_shipdate)::DATE AS p, l_suppkey AS holder, sum(l_quantity) AS amount FROM lineitem GROUP BY 1, 2, 3), n AS (SELECT * FROM t QUALIFY p = max(p) OVER (PARTITION BY code))
    SELECT code, p::VARCHAR AS period, holder, amount, row_number() OVER (PARTITION BY code ORDER BY amount DESC, holder)::INT AS place FROM n QUALIFY row_number() OVER (PARTITION BY code ORDER BY amount DESC, holder) <= 10""")
def f_holders(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(_c("l_partkey").alias("code"), F.trunc("l_shipdate", "quarter").alias("period"), _c("l_suppkey").alias("holder")).agg(F.sum("l_quantity").alias("amount"))
    return rp.newest_holders(t, "period", [F.desc("amount"), F.asc("holder")])


def _displayed(value: str):
    """Statement periods: the five newest full years and the quarters after them."""
    sql = f"""WITH {_YEAR}, l AS (SELECT *, max(yr) FILTER (q = 4) OVER (PARTITION BY code) AS y4 FROM fin), r AS (SELECT *, dense_rank() OVER (PARTITION BY code ORDER BY CASE WHEN q = 4 THEN yr END DESC NULLS LAST) AS r FROM l)
    SELECT code, yr::VARCHAR || CASE WHEN q = 4 THEN '' WHEN q = 2 THEN 'H1' ELSE 'Q' || q END AS label, {value} AS value FROM r WHERE (q = 4 AND r <= 5) OR (q <> 4 AND yr > coalesce(y4, 0))"""
    return sql, lambda spark, sf_dir: dv.display_periods(_quarters(spark, sf_dir), "code", "yr", "q").select("code", "label", F.expr(value).alias("value"))


for _name, _value in {"f_balance": "n", "f_indicators": "round(rev / n, 4)"}.items():
    ORACLES[_name], QUERIES[_name] = _displayed(_value)


@query("""WITH v AS (SELECT o_custkey AS code, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS pe FROM orders GROUP BY 1), r AS (SELECT user_id AS code, arg_max(value, (ts, event_id)) AS roe FROM events GROUP BY 1)
    SELECT code, pe, roe FROM v LEFT JOIN r USING (code)""")
def f_snapshot(spark, sf_dir):
    """The latest valuation with the latest return on equity of each symbol."""
    v = table(spark, sf_dir, "orders").groupBy(_c("o_custkey").alias("code")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("pe"))
    r = table(spark, sf_dir, "events").groupBy(_c("user_id").alias("code")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("roe"))
    return v.join(r, "code", "left")


_PERIODS = ["2030Q4", "2030Q3", "1997Q4", "1997Q3", "1996Q4", "2024Q1", "1995Q4", "1998Q2"]


@query(f"""WITH {_YEAR}, t AS (SELECT code, yr || 'Q' || q AS period, rev, list_position({_PERIODS}, yr || 'Q' || q) AS o FROM fin WHERE list_contains({_PERIODS}, yr || 'Q' || q)) SELECT code, period, rev AS roe FROM t WHERE o = (SELECT min(o) FROM t)""")
def f_roe_map(spark, sf_dir):
    """The values of the first period of a list that has any."""
    t = _quarters(spark, sf_dir).select("code", F.concat("yr", F.lit("Q"), "q").alias("period"), _c("rev").alias("roe"))
    return rp.first_with_data(t, "period", _PERIODS, "roe")


@query(f"WITH {SNAPSHOT} SELECT code, total_mv, pe, pb, n_orders AS turnover FROM snap WHERE total_mv IS NOT NULL")
def f_mv_map(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).where("total_mv is not null").select("code", "total_mv", "pe", "pb", _c("n_orders").alias("turnover"))


@query(f"WITH {SNAPSHOT} SELECT code, total_mv / 10000 AS total_mv, total_mv * 0.7::DOUBLE / 10000 AS circ_mv, pe, CASE WHEN abs(pb) < 1e308 THEN pb END AS pb FROM snap")
def prj_metrics(spark, sf_dir):
    """Market values in units of 10,000; what isn't a number goes."""
    number = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return customer_snapshot(spark, sf_dir).select("code", (_c("total_mv") / 10000).alias("total_mv"), (_c("total_mv") * 0.7 / 10000).alias("circ_mv"), number(_c("pe")).alias("pe"), number(_c("pb")).alias("pb"))


@query("""WITH t AS (SELECT o_custkey AS symbol, o_orderpriority AS data_source, o_orderkey, o_totalprice, list_position(['2-HIGH', '1-URGENT', '5-LOW'], o_orderpriority) AS o FROM orders WHERE o_orderpriority IN ('2-HIGH', '1-URGENT', '5-LOW'))
    SELECT symbol, data_source, o_orderkey, o_totalprice FROM t QUALIFY o = min(o) OVER (PARTITION BY symbol)""")
def flt_hist_cached(spark, sf_dir):
    """A symbol's history from the first of its sources by priority."""
    t = table(spark, sf_dir, "orders").select(_c("o_custkey").alias("symbol"), _c("o_orderpriority").alias("data_source"), "o_orderkey", "o_totalprice")
    return rp.by_source_priority(t, ["2-HIGH", "1-URGENT", "5-LOW"])


@query("""WITH p AS (SELECT o_orderpriority AS name, count(*) AS priority FROM orders GROUP BY 1), e AS (SELECT name, row_number() OVER (ORDER BY priority DESC, name) AS o FROM p WHERE name <> '1-URGENT')
    SELECT o_custkey AS code, arg_min(o_orderpriority, o) AS data_source, count(*) FILTER (o = m) AS n FROM (SELECT *, min(o) OVER (PARTITION BY o_custkey) AS m FROM orders JOIN e ON name = o_orderpriority) GROUP BY 1""")
def src_source_priority(spark, sf_dir):
    """Sources ranked by how much they hold, one of them switched off; each company's rows come from its first."""
    t = table(spark, sf_dir, "orders").select(_c("o_custkey").alias("code"), _c("o_orderpriority").alias("data_source"))
    config = t.groupBy(_c("data_source").alias("name")).agg(F.count("*").alias("priority")).withColumn("enabled", _c("name") != "1-URGENT")
    return rp.by_source_priority(t, rp.enabled_sources(config), "code").groupBy("code", "data_source").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN position('the' IN lower(text)) > 0 THEN 1 ELSE 0 END + CASE WHEN position('data' IN lower(text)) > 0 THEN 1 ELSE 0 END AS score FROM conversations WHERE role = 'assistant' AND (position('the' IN lower(text)) > 0 OR position('data' IN lower(text)) > 0) ORDER BY score DESC, conv_id, turn LIMIT 50")
def nlp_internal_search(spark, sf_dir):
    """Messages of one kind that hold any of the words, by how many they hold."""
    hit = lambda w: F.lower("text").contains(w).cast("int")
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("score", hit("the") + hit("data"))
    return t.where("score > 0").orderBy(F.desc("score"), "conv_id", "turn").limit(50).select("conv_id", "turn", "score")


# --- codes -----------------------------------------------------------------------------------------------------------

_CODES = "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_orderkey % 4 WHEN 0 THEN 'sh' || l_partkey WHEN 1 THEN l_partkey || '.SZ' WHEN 2 THEN lpad(l_partkey::VARCHAR, 6, '6') ELSE l_partkey || '.HK' END AS raw FROM lineitem"


def _codes(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part, k = _c("l_partkey").cast("string"), _c("l_orderkey") % 4
    return t.withColumn("raw", F.when(k == 0, F.concat(F.lit("sh"), part)).when(k == 1, F.concat(part, F.lit(".SZ"))).when(k == 2, F.lpad(part, 6, "6")).otherwise(F.concat(part, F.lit(".HK"))))


@query(f"WITH c AS ({_CODES}) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 4 = 2 AND length(raw) = 6 THEN 'CN' WHEN l_orderkey % 4 = 3 AND l_partkey < 100000 THEN 'HK' WHEN l_orderkey % 4 = 1 AND l_partkey BETWEEN 100000 AND 999999 THEN 'CN' ELSE 'unknown' END AS market FROM c")
def fn_market_id(spark, sf_dir):
    return _codes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", sc.market_class(_c("raw")).alias("market"))


@query("SELECT o_custkey AS code, arg_max(v, yr) AS ttm FROM (SELECT o_custkey, year(o_orderdate) AS yr, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2) GROUP BY 1")
def f_ttm_rev(spark, sf_dir):
    """Trailing revenue where only whole years are reported: the newest year's."""
    from quantloom.operators import fundamentals as fm

    t = table(spark, sf_dir, "orders").groupBy(_c("o_custkey").alias("code"), F.year("o_orderdate").alias("yr")).agg(F.round(F.sum("o_totalprice"), 2).alias("rev"))
    return fm.ttm(t.withColumn("q", F.lit(4)), "code", "yr", "q", "rev", positive=True)


@query(f"WITH {BARS}, c AS (SELECT trade_date, symbol, close FROM bars) SELECT trade_date::VARCHAR AS trade_date, max(close) FILTER (symbol = 'Brand#1') AS b1, max(close) FILTER (symbol = 'Brand#2') AS b2, count(*) AS n FROM c GROUP BY 1")
def src_prices_multi(spark, sf_dir):
    """Prices of many tickers by date, kept in the cache and read from there the second time."""
    from quantloom.sources.cache import ParquetCache
    from quantloom.sources.shared import scratch

    cache = ParquetCache(spark, scratch(spark, "prices"))
    for _ in range(2):
        prices = cache.get_or_make("prices:weekly", lambda: weekly_brand_bars(spark, sf_dir).select("symbol", "trade_date", "close"), ttl=7200)
    one = lambda s: F.max(F.when(_c("symbol") == s, _c("close")))
    return prices.groupBy("trade_date").agg(one("Brand#1").alias("b1"), one("Brand#2").alias("b2"), F.count("*").alias("n"))
