"""Queries of scalar functions and quant measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import scalar as sc
from quantloom.functions import sql
from quantloom.operators import quant
from quantloom.sources.bars import BARS, table, weekly_brand_bars

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


_CODES = """codes AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'sh' || (600000 + c_custkey) WHEN 1 THEN (300000 + c_custkey) || '.SZ' WHEN 2 THEN (920000 + c_custkey)::VARCHAR
    WHEN 3 THEN c_custkey::VARCHAR WHEN 4 THEN (c_custkey % 1000) || '.HK' ELSE 'ABC' END AS code FROM customer)"""


def _codes(spark, sf_dir):
    k = _c("c_custkey")
    m = k % 6
    code = F.when(m == 0, F.concat(F.lit("sh"), (600000 + k).cast("string"))).when(m == 1, F.concat((300000 + k).cast("string"), F.lit(".SZ"))).when(m == 2, (920000 + k).cast("string"))
    code = code.when(m == 3, k.cast("string")).when(m == 4, F.concat((k % 1000).cast("string"), F.lit(".HK"))).otherwise("ABC")
    return table(spark, sf_dir, "customer").select(k.alias("k"), code.alias("code"))


_STRIP = "regexp_replace(regexp_replace(code, '(?i)^(sh|sz|bj)[.]?', ''), '(?i)[.]?(sh|sz|bj)$', '')"
_PAD = f"CASE WHEN length({_STRIP}) >= 6 THEN {_STRIP} ELSE lpad({_STRIP}, 6, '0') END"
_SUF = f"CASE WHEN regexp_matches({_PAD}, '^(8|4|920)') THEN 'BJ' WHEN regexp_matches({_PAD}, '^(6|9)') THEN 'SH' ELSE 'SZ' END"


@query(f"WITH {_CODES} SELECT k, {_STRIP} AS bare FROM codes")
def fn_strip_prefix(spark, sf_dir):
    return _codes(spark, sf_dir).select("k", sc.strip_prefix(_c("code")).alias("bare"))


@query(f"WITH {_CODES} SELECT k, regexp_replace(regexp_replace(split_part(trim(code), '.', 1), '(?i)^(sh|sz|bj)[.]?', ''), '(?i)[.]?(sh|sz|bj)$', '') AS code FROM codes WHERE trim(code) <> '' AND lower(trim(code)) NOT IN ('nan', 'none')")
def fn_norm_code(spark, sf_dir):
    return _codes(spark, sf_dir).select("k", sc.bare_code(_c("code")).alias("code")).where("code is not null")


@query("SELECT c_custkey AS code, CASE WHEN c_mktsegment LIKE 'A%' OR c_mktsegment LIKE 'B%' THEN c_custkey || CASE WHEN starts_with(c_custkey::VARCHAR, '6') THEN '.SH' ELSE '.SZ' END WHEN c_mktsegment LIKE 'F%' THEN c_custkey || '.HK' ELSE c_custkey::VARCHAR END AS symbol FROM customer")
def prj_full_symbol(spark, sf_dir):
    first = F.substring("c_mktsegment", 1, 1)
    market = F.when(first.isin("A", "B"), "CN").when(first == "F", "HK").otherwise("US")
    return table(spark, sf_dir, "customer").select(_c("c_custkey").alias("code"), sc.full_symbol(_c("c_custkey").cast("string"), market).alias("symbol"))


@query(f"WITH {_CODES} SELECT k, nullif(regexp_extract(code, '\\d{{6}}'), '') AS code FROM codes")
def fn_code6(spark, sf_dir):
    return _codes(spark, sf_dir).select("k", sc.code6(_c("code")).alias("code"))


@query(f"WITH {_CODES} SELECT k, {_PAD} || '.' || {_SUF} AS code, {_SUF} AS suffix, CASE {_SUF} WHEN 'SH' THEN 'SSE' WHEN 'SZ' THEN 'SZSE' ELSE 'BSE' END AS exchange FROM codes")
def fn_ts_code(spark, sf_dir):
    s = sc.suffix(sc.pad6(sc.strip_prefix(_c("code"))))
    return _codes(spark, sf_dir).select("k", sc.ts_code(_c("code")).alias("code"), s.alias("suffix"), sc.exchange(s).alias("exchange"))


@query(f"WITH {_CODES} SELECT k, CASE WHEN regexp_matches(code, '^\\d{{6}}([.](SH|SZ|BJ))?$') THEN 'CN' WHEN regexp_matches(code, '^\\d{{1,5}}([.]HK)?$') THEN 'HK' WHEN regexp_matches(upper(code), '^[A-Z]{{1,5}}([.][A-Z])?$') THEN 'US' ELSE 'unknown' END AS market FROM codes")
def fn_market_class(spark, sf_dir):
    return _codes(spark, sf_dir).select("k", sc.market_class(_c("code")).alias("market"))


@query(f"WITH {_CODES} SELECT k, CASE WHEN code LIKE '%.HK' THEN 'HKD' WHEN code LIKE '%.US' THEN 'USD' ELSE 'CNY' END AS currency FROM codes")
def fn_currency(spark, sf_dir):
    return _codes(spark, sf_dir).select("k", sc.currency(_c("code")).alias("currency"))


@query(f"WITH {_CODES} SELECT k, lpad(CASE WHEN ltrim(regexp_replace(code, '[.]HK$', ''), '0') = '' THEN '0' ELSE ltrim(regexp_replace(code, '[.]HK$', ''), '0') END, 5, '0') || '.HK' AS code FROM codes WHERE code LIKE '%.HK'")
def fn_hk_norm(spark, sf_dir):
    return _codes(spark, sf_dir).where(_c("code").endswith(".HK")).select("k", sc.hk_code(_c("code")).alias("code"))


@query(f"WITH {_CODES} SELECT k, TRY_CAST(code AS DOUBLE) AS v FROM codes")
def fn_safe_float(spark, sf_dir):
    return _codes(spark, sf_dir).select("k", sc.safe_float(_c("code")).alias("v"))


_DATES = "dates AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN strftime(o_orderdate, '%Y.%m.%d') ELSE 'soon' END AS d, o_orderdate AS t FROM orders)"


def _dates(spark, sf_dir):
    k, t = _c("o_orderkey"), _c("o_orderdate")
    d = F.when(k % 5 == 0, F.date_format(t, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(t, "yyyy/MM/dd")).when(k % 5 == 2, F.date_format(t, "yyyyMMdd")).when(k % 5 == 3, F.date_format(t, "yyyy.MM.dd")).otherwise("soon")
    return table(spark, sf_dir, "orders").select(k.alias("k"), d.alias("d"))


@query(f"WITH {_DATES} SELECT k, CASE WHEN d <> 'soon' THEN strftime(t, '%Y%m%d') END AS ymd FROM dates")
def fn_date_norm(spark, sf_dir):
    return _dates(spark, sf_dir).select("k", sc.compact_date(_c("d")).alias("ymd"))


@query(f"WITH {_DATES} SELECT k, CASE WHEN d <> 'soon' THEN strftime(t, '%Y-%m-%d') END AS day FROM dates")
def fn_date_iso(spark, sf_dir):
    return _dates(spark, sf_dir).select("k", sc.iso_date(_c("d")).alias("day"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN year(o_orderdate) || '0331' WHEN 1 THEN year(o_orderdate) || '0630' WHEN 2 THEN year(o_orderdate) || '0930' WHEN 3 THEN year(o_orderdate) || '1231' END AS period FROM orders")
def fn_report_period(spark, sf_dir):
    k, y = _c("o_orderkey"), F.year("o_orderdate").cast("string")
    title = F.concat(y, F.when(k % 5 == 0, "年一季报").when(k % 5 == 1, "年中报").when(k % 5 == 2, "年三季报").when(k % 5 == 3, "年年报").otherwise("?"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), sc.report_period(title).alias("period"))


_T = "strftime(ts, '%H:%M:%S')"


@query(f"""SELECT event_id, isodow(ts) <= 5 AND ({_T} BETWEEN '09:30:00' AND '11:30:00' OR {_T} BETWEEN '13:00:00' AND '15:30:00') AS open,
    isodow(ts) <= 5 AND ({_T} BETWEEN '09:30:00' AND '11:30:00' OR {_T} BETWEEN '13:00:00' AND '15:00:00') AS strict,
    isodow(ts) <= 5 AND {_T} >= '09:00:00' AND {_T} < '09:30:00' AS pre, isodow(ts) <= 5 AND {_T} BETWEEN '15:00:00' AND '15:30:00' AS after FROM events""")
def fn_trading_time(spark, sf_dir):
    ts = _c("ts")
    return table(spark, sf_dir, "events").select("event_id", sc.trading_time(ts).alias("open"), sc.trading_time(ts, "15:00:00").alias("strict"), sc.pre_market(ts).alias("pre"), sc.after_market(ts).alias("after"))


@query(f"""SELECT event_id, CASE WHEN isodow(ts) > 5 THEN 'weekend' WHEN {_T} < '09:00:00' THEN 'closed' WHEN {_T} < '09:30:00' THEN 'pre_market' WHEN {_T} <= '11:30:00' THEN 'morning'
    WHEN {_T} < '13:00:00' THEN 'noon_break' WHEN {_T} <= '15:00:00' THEN 'afternoon' WHEN {_T} <= '15:30:00' THEN 'after_market' ELSE 'closed' END AS status FROM events""")
def fn_trading_status(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sc.trading_status(_c("ts")).alias("status"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 < 2 THEN floor(o_totalprice)::DOUBLE END AS price FROM orders")
def fn_price_extract(spark, sf_dir):
    k, p = _c("o_orderkey"), F.floor("o_totalprice").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("目标价位: ¥"), p, F.lit(" 元"))).when(k % 3 == 1, F.concat(F.lit("see $"), p)).otherwise("none")
    return table(spark, sf_dir, "orders").select(k.alias("k"), sc.target_price(text).alias("price"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_pick(spark, sf_dir):
    text = F.concat(F.lit("answer: "), _c("props"), F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "k long")["k"].alias("k"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 280) || ' ... ' || right(text, 115) END AS text FROM documents")
def fn_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sc.truncated(_c("text"), 400).alias("text"))


@query("SELECT event_id, '' AS token, user_id::VARCHAR AS owner FROM events")
def fn_sanitize(spark, sf_dir):
    m = F.create_map(F.lit("api_token"), _c("props"), F.lit("owner"), _c("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", sc.sanitized(m)["api_token"].alias("token"), sc.sanitized(m)["owner"].alias("owner"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS a, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS sale FROM orders)
    SELECT k, round(CASE k % 3 WHEN 0 THEN greatest(a * 0.0003::DOUBLE, 5) + sale * 0.001::DOUBLE
    WHEN 1 THEN greatest(a * 0.0003::DOUBLE, 3) + sale * 0.001::DOUBLE + a * (0.000027::DOUBLE + 0.00005::DOUBLE + 0.00002::DOUBLE) ELSE sale * 0.0000278::DOUBLE END, 9) AS fee FROM o""")
def paper_fee(spark, sf_dir):
    k = _c("o_orderkey")
    market = F.when(k % 3 == 0, "CN").when(k % 3 == 1, "HK").otherwise("US")
    side = F.when(_c("o_orderstatus") == "F", "sell").otherwise("buy")
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.round(sc.commission(market, side, _c("o_totalprice")), 9).alias("fee"))


# --- quant -----------------------------------------------------------------------------------------------------------

_RET = f"{BARS}, r AS (SELECT symbol, trade_date, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS ret FROM bars)"


def _returns(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    return weekly_brand_bars(spark, sf_dir).select("symbol", "trade_date", "close", (F.try_divide(_c("close"), F.lag("close").over(w)) - 1).alias("ret"))


def _agg(**measures):
    def run(spark, sf_dir):
        return _returns(spark, sf_dir).groupBy("symbol").agg(*[F.round(f(_c("ret")), 7).alias(k) for k, f in measures.items()])

    return run


def _agg_sql(**measures):
    return f"WITH {_RET} SELECT symbol, " + ", ".join(f"round({v}, 7) AS {k}" for k, v in measures.items()) + " FROM r WHERE ret IS NOT NULL GROUP BY 1"


QUERIES |= {
    "q_ann_return": _agg(v=quant.annualized_return), "q_ann_vol": _agg(v=quant.annualized_volatility), "q_sharpe": _agg(v=lambda r: quant.sharpe(r, 0.02)),
    "q_sortino": _agg(v=quant.sortino), "q_var_param": _agg(v=quant.parametric_var),
}
ORACLES |= {
    "q_ann_return": _agg_sql(v="pow(product(1 + ret), 244.0::DOUBLE / count(*)) - 1"),
    "q_ann_vol": _agg_sql(v="stddev_samp(ret) * sqrt(244)"),
    "q_sharpe": _agg_sql(v="(avg(ret) - 0.02::DOUBLE / 244) / stddev_samp(ret) * sqrt(244)"),
    "q_sortino": _agg_sql(v="avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(244)"),
    "q_var_param": _agg_sql(v="-(avg(ret) - 1.6448536269514722::DOUBLE * stddev_samp(ret))"),
}


@query(f"WITH {_RET}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL) SELECT symbol, round(-max(ret), 7) AS var, round(-avg(ret), 7) AS cvar FROM k WHERE k <= ceil(0.05::DOUBLE * n - 1e-9::DOUBLE) GROUP BY 1")
def q_var_hist(spark, sf_dir):
    t = quant.ranked_losses(_returns(spark, sf_dir), "symbol", "ret")
    return t.select("symbol", F.round("var", 7).alias("var"), F.round("cvar", 7).alias("cvar"))


@query(f"WITH {BARS}, d AS (SELECT symbol, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS dd FROM bars) SELECT symbol, round(max(dd), 7) AS mdd FROM d GROUP BY 1")
def q_mdd(spark, sf_dir):
    return quant.drawdown(_returns(spark, sf_dir), "symbol", "trade_date", "close").select("symbol", F.round("mdd", 7).alias("mdd"))


@query(f"WITH {_RET}, d AS (SELECT symbol, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS dd, ret FROM r) SELECT symbol, round((pow(product(1 + ret), 244.0::DOUBLE / count(ret)) - 1) / nullif(max(dd), 0), 6) AS calmar FROM d GROUP BY 1")
def q_calmar(spark, sf_dir):
    r = _returns(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    t = r.withColumn("dd", 1 - F.try_divide(_c("close"), F.max("close").over(w)))
    return t.groupBy("symbol").agg(F.round(F.try_divide(quant.annualized_return(_c("ret")), F.max("dd")), 6).alias("calmar"))


@query(f"WITH {_RET}, b AS (SELECT trade_date, avg(ret) AS b FROM r GROUP BY 1), a AS (SELECT symbol, ret - b AS x FROM r JOIN b USING (trade_date) WHERE ret IS NOT NULL) SELECT symbol, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(244), 6) AS ir FROM a GROUP BY 1")
def q_info(spark, sf_dir):
    r = _returns(spark, sf_dir)
    b = r.groupBy("trade_date").agg(F.avg("ret").alias("b"))
    x = _c("ret") - _c("b")
    return r.join(b, "trade_date").where("ret is not null").groupBy("symbol").agg(F.round(F.try_divide(F.avg(x), F.stddev_samp(x)) * 244**0.5, 6).alias("ir"))


_CF = "cf AS (SELECT o_custkey AS code, o_orderdate::DATE AS d, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS a FROM orders)"


def _flows(spark, sf_dir):
    a = F.when(_c("o_orderstatus") == "F", -_c("o_totalprice")).otherwise(_c("o_totalprice"))
    return table(spark, sf_dir, "orders").select(_c("o_custkey").alias("code"), F.to_date("o_orderdate").alias("d"), a.alias("a"))


@query(f"WITH {_CF} SELECT code, round(sum(a) FILTER (a > 0) / nullif(-sum(a) FILTER (a < 0), 0), 7) AS dpi, round((coalesce(sum(a) FILTER (a > 0), 0) + 1000) / nullif(-sum(a) FILTER (a < 0), 0), 7) AS tvpi FROM (SELECT code, a FROM cf UNION ALL SELECT DISTINCT code, 0.001::DOUBLE FROM cf) GROUP BY 1")
def q_dpi(spark, sf_dir):
    t = _flows(spark, sf_dir).select("code", "a")
    t = t.union(t.select("code", F.lit(0.001)).distinct())
    return t.groupBy("code").agg(F.round(quant.dpi(_c("a")), 7).alias("dpi"), F.round(quant.tvpi(_c("a"), F.lit(1000.0)), 7).alias("tvpi"))


@query("SELECT c_custkey AS code, CASE WHEN c_acctbal > 0 THEN round(1000 / c_acctbal, 7) END AS moic FROM customer")
def q_moic(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(_c("c_custkey").alias("code"), F.round(quant.moic(_c("c_acctbal"), F.lit(1000.0)), 7).alias("moic"))


@query(None)
def q_xirr(spark, sf_dir):
    return quant.xirr(_flows(spark, sf_dir), "code", "d", "a")


@query(None)
def q_options(spark, sf_dir):
    """Price, greeks and implied volatility for each part as an option on its retail price."""
    t = table(spark, sf_dir, "part").select("p_partkey", _c("p_retailprice").alias("s"), (_c("p_retailprice") * 1.05).alias("k"), (_c("p_size") / 50).alias("t"), F.lit(0.05).alias("r"), F.lit(0.2).alias("v"), (_c("p_partkey") % 2 == 0).alias("call"))
    return quant.option_values(t)


@query(f"""WITH {_RET}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL),
    c AS (SELECT symbol, -avg(ret) AS cvar FROM k WHERE k <= ceil(0.1::DOUBLE * n - 1e-9::DOUBLE) GROUP BY 1), d AS (SELECT symbol, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS dd FROM bars)
    SELECT symbol, round((avg(ret) - 0.02::DOUBLE / 244) / stddev_samp(ret) * sqrt(244), 7) AS sharpe, round(avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(244), 7) AS sortino, round(any_value(cvar), 7) AS cvar,
        round((SELECT max(dd) FROM d WHERE d.symbol = k.symbol), 7) AS mdd, round(pow(product(1 + ret), 52.0::DOUBLE / count(*)) - 1, 7) AS ann_return FROM k JOIN c USING (symbol) GROUP BY 1""")
def q_sql(spark, sf_dir):
    """Measures called from SQL text, with parameters by place and by name."""
    sql.register(spark)
    return spark.sql("""SELECT symbol, round(q_sharpe(r, 0.02D), 7) AS sharpe, round(q_sortino(r), 7) AS sortino, round(q_cvar(r, 0.9D), 7) AS cvar, round(q_mdd(e), 7) AS mdd, round(q_ann_return(r, 52D), 7) AS ann_return
        FROM (SELECT symbol, transform(array_sort(collect_list(struct(trade_date, close))), x -> x.close) AS e, collect_list(ret) AS r FROM {returns} GROUP BY symbol)""", returns=_returns(spark, sf_dir))


@query(f"WITH {_RET}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL) SELECT symbol, 'cvar' AS measure, round(-avg(ret), 7) AS value FROM k WHERE k <= ceil(0.1::DOUBLE * n - 1e-9::DOUBLE) GROUP BY 1")
def q_sql_dispatch(spark, sf_dir):
    """A measure by its name, for each row of a query."""
    sql.register(spark)
    return spark.sql("""SELECT symbol, q.measure, round(q.value, 7) AS value FROM (SELECT symbol, collect_list(ret) AS r FROM {returns} GROUP BY symbol), LATERAL quant('cvar', r, confidence => 0.9D) q""", returns=_returns(spark, sf_dir))
