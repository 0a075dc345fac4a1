"""Queries of scans, predicates, joins, aggregations, orders and sets on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import relational as rel
from quantloom.operators import screen
from quantloom.sources.bars import BARS, SNAPSHOT, TYPE_BARS, customer_snapshot, daily_type_bars, table, weekly_brand_bars

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


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.latest(_orders(spark, sf_dir), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


LATEST = "lo AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"

# --- scans -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def src_daily(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    return t.where((_c("ts") >= F.lit("2024-01-05").cast("timestamp")) & (_c("ts") < F.lit("2024-01-08").cast("timestamp"))).select("event_id", "user_id", "event_type", "value")


@query(f"WITH {BARS} SELECT symbol, trade_date, volume / 100 AS volume, amount / 1000 AS amount FROM bars")
def src_hist(spark, sf_dir):
    return weekly_brand_bars(spark, sf_dir).select("symbol", "trade_date", (_c("volume") / 100).alias("volume"), (_c("amount") / 1000).alias("amount"))


@query("SELECT c_custkey AS code, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT p_partkey, p_name, 'part' FROM part")
def src_stock_basic(spark, sf_dir):
    out = None
    for name, key, label in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        t = table(spark, sf_dir, name).select(_c(key).alias("code"), _c(label).alias("name"), F.lit(name).alias("kind"))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


@query("SELECT DISTINCT o_orderdate::DATE AS cal_date, 1 AS is_open FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def src_trade_cal(spark, sf_dir):
    t = _orders(spark, sf_dir).where(_c("o_orderdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1996-06-30").cast("timestamp")))
    return t.select(F.to_date("o_orderdate").alias("cal_date")).distinct().withColumn("is_open", F.lit(1))


@query(f"WITH {SNAPSHOT} SELECT code, pe, pb, total_mv FROM snap WHERE code IN (1, 5, 9, 77)")
def src_daily_basic(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).where(_c("code").isin(1, 5, 9, 77)).select("code", "pe", "pb", "total_mv")


@query("SELECT l_orderkey AS code, l_extendedprice AS revenue, CAST(NULL AS DOUBLE) AS minority, l_tax AS tax FROM lineitem")
def src_pick(spark, sf_dir):
    return rel.pick(table(spark, sf_dir, "lineitem"), {"code": "l_orderkey", "revenue": ["total_revenue", "l_extendedprice"], "minority": ["minority_gain"], "tax": ["l_tax", "l_discount"]})


@query(f"WITH {TYPE_BARS} SELECT symbol, trade_date, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS pct_change FROM tbars")
def src_normalize(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    return daily_type_bars(spark, sf_dir).select("symbol", "trade_date", "close", (F.try_divide(_c("close"), F.lag("close").over(w)) - 1).alias("pct_change"))


@query("SELECT code, name, kind FROM (SELECT c_custkey AS code, c_name AS name, 'customer' AS kind, 0 AS p FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_suppkey, s_name, 'supplier', 1 FROM supplier) QUALIFY row_number() OVER (PARTITION BY code ORDER BY p) = 1")
def src_with_fallback(spark, sf_dir):
    first = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(_c("c_custkey").alias("code"), _c("c_name").alias("name"), F.lit("customer").alias("kind"))
    second = table(spark, sf_dir, "supplier").select(_c("s_suppkey").alias("code"), _c("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return rel.coalesce_sources([first, second], ["code"])


@query(f"WITH {BARS} SELECT symbol, trade_date, round(least(greatest(volume / avg(volume) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0), 10), 6) AS turnover FROM bars")
def src_chip_klines(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-19, 0)
    ratio = F.try_divide(_c("volume"), F.avg("volume").over(w))
    return weekly_brand_bars(spark, sf_dir).select("symbol", "trade_date", F.round(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(10.0)), 6).alias("turnover"))


# --- predicates ------------------------------------------------------------------------------------------------------

FLAT = [
    {"field": "balance", "operator": ">", "value": 9000},
    {"field": "balance", "operator": "between", "value": [0, 5000]},
    {"field": "industry", "operator": "in", "value": ["BUILDING", "MACHINERY"]},
    {"field": "nowhere", "operator": "==", "value": 1},
]


@query(f"WITH {SNAPSHOT} SELECT code, industry, balance FROM snap WHERE balance BETWEEN 0 AND 5000 AND industry IN ('BUILDING', 'MACHINERY')")
def flt_db_dsl(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir)
    return t.where(screen.flat(FLAT, set(t.columns))).select("code", "industry", "balance")


@query(f"WITH {SNAPSHOT} SELECT code FROM snap WHERE (n_orders IS NULL OR n_orders <> 3) AND (pe IS NULL OR pe NOT IN (1.0, 2.0))")
def flt_ops_null(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir)
    return t.where(screen.flat([{"field": "n_orders", "operator": "!=", "value": 3}, {"field": "pe", "operator": "not_in", "value": [1.0, 2.0]}], set(t.columns))).select("code")


@query(f"WITH {SNAPSHOT} SELECT code, area FROM snap WHERE regexp_matches(area, '(?i)i.*a')")
def flt_contains(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir)
    return t.where(screen.flat([{"field": "area", "operator": "contains", "value": "i.*a"}], set(t.columns))).select("code", "area")


@query(f"WITH {SNAPSHOT} SELECT code, pb FROM snap WHERE pb BETWEEN 1 AND 2.5")
def flt_between(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir)
    return t.where(screen.flat([{"field": "pb", "operator": "between", "value": [1, 2.5]}, {"field": "pe", "operator": "between", "value": [1]}], set(t.columns))).select("code", "pb")


TREE = {"logic": "OR", "children": [{"field": "close", "op": ">", "right_field": "open"}, {"logic": "AND", "children": [{"field": "volume", "op": ">=", "value": 200}, {"field": "close", "op": "!=", "value": 0}]}, {"field": "nope", "op": "!=", "value": 1}]}


@query(f"WITH {BARS} SELECT symbol, trade_date, close FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1) WHERE close > open OR (volume >= 200 AND close <> 0)")
def flt_tree(spark, sf_dir):
    return screen.on_last_bar(weekly_brand_bars(spark, sf_dir), TREE).select("symbol", "trade_date", "close")


def _crossed(op):
    def run(spark, sf_dir):
        w = Window.partitionBy("symbol").orderBy("trade_date")
        t = weekly_brand_bars(spark, sf_dir).withColumn("ma", F.avg("close").over(w.rowsBetween(-4, 0)))
        return t.withColumn("hit", screen.leaf({"field": "close", "op": op, "right_field": "ma"}, set(t.columns))).where("hit").select("symbol", "trade_date")

    return run


_MA = f"WITH {BARS}, m AS (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma FROM bars), x AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS c0, lag(ma) OVER (PARTITION BY symbol ORDER BY trade_date) AS m0 FROM m) SELECT symbol, trade_date FROM x WHERE "
QUERIES |= {"flt_cross_up": _crossed("cross_up"), "flt_cross_down": _crossed("cross_down")}
ORACLES |= {"flt_cross_up": _MA + "c0 <= m0 AND close > ma", "flt_cross_down": _MA + "c0 >= m0 AND close < ma"}


@query(f"WITH {SNAPSHOT} SELECT code FROM snap WHERE pe > 15 AND pb < 5")
def flt_fund_tree(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir)
    node = {"logic": "AND", "children": [{"field": "pe", "op": ">", "value": 15}, {"field": "rsi", "op": "<", "value": 30}, {"field": "pb", "op": "<", "value": 5}]}
    return t.where(screen.tree(node, {"pe", "pb", "total_mv"}, foreign=True)).select("code")


@query(f"WITH {SNAPSHOT}, {LATEST} SELECT code, o_totalprice FROM snap JOIN lo ON o_custkey = code WHERE balance > 0 AND o_totalprice > 100000")
def flt_quotes(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir).where("balance > 0")
    q = _latest_orders(spark, sf_dir).where("o_totalprice > 100000").select(_c("o_custkey").alias("code"), "o_totalprice")
    return t.join(q, "code").select("code", "o_totalprice")


@query(f"WITH {SNAPSHOT} SELECT code, total_mv FROM snap WHERE total_mv >= 200 AND pe > 10")
def flt_legacy(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir)
    old = {"logic": "AND", "children": [{"field": "market_cap", "op": "gte", "value": 2000000}, {"field": "pe_ratio", "op": "gt", "value": 10}, {"logic": "OR", "children": []}]}
    return t.where(screen.flat(screen.from_legacy(old), set(t.columns))).select("code", "total_mv")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 500 AND 3000 AND source <> 'src3' AND contains(lower(text), 'the')")
def flt_news(spark, sf_dir):
    t = table(spark, sf_dir, "documents")
    return t.where(_c("lang").isin("en", "de") & _c("n_chars").between(500, 3000) & (_c("source") != "src3") & F.lower("text").contains("the")).select("doc_id", "lang", "source")


@query("SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AND event_type IN ('click', 'view', 'purchase')")
def flt_social(spark, sf_dir):
    t = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return t.where((_c("p.k") > 50) & _c("event_type").isin("click", "view", "purchase")).select("event_id", "user_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND (regexp_matches(text, '(?i)the') OR regexp_matches(role, '(?i)sys'))")
def flt_internal(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.where((_c("role") == "user") & (_c("text").rlike("(?i)the") | _c("role").rlike("(?i)sys"))).select("conv_id", "turn", "role")


@query("SELECT event_id, ts FROM events WHERE regexp_matches(event_type, '(?i)c') OR regexp_matches(props, '99') ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20")
def flt_logs(spark, sf_dir):
    t = table(spark, sf_dir, "events").where(_c("event_type").rlike("(?i)c") | _c("props").rlike("99"))
    return t.orderBy(F.desc("ts"), "event_id").offset(20).limit(20).select("event_id", "ts")


@query("SELECT code, name FROM (SELECT c_custkey AS code, c_name AS name, 0 AS p FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) WHERE regexp_matches(name, '(?i)0+12') QUALIFY row_number() OVER (PARTITION BY code ORDER BY p) = 1 ORDER BY code LIMIT 20")
def flt_search_stock(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(_c("c_custkey").alias("code"), _c("c_name").alias("name"), F.lit(0).alias("p"))
    b = table(spark, sf_dir, "supplier").select(_c("s_suppkey").alias("code"), _c("s_name").alias("name"), F.lit(1).alias("p"))
    hits = a.unionByName(b).where(_c("name").rlike("(?i)0+12"))
    return rel.latest(hits, ["code"], [F.asc("p")]).orderBy("code").limit(20).select("code", "name")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def flt_history(spark, sf_dir):
    return _orders(spark, sf_dir).where("o_custkey = 7").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select("o_orderkey", "o_orderdate")


@query(f"WITH {SNAPSHOT} SELECT code, CASE WHEN pe IS NULL THEN 'observation' ELSE 'main' END AS channel FROM snap WHERE NOT regexp_matches(name, '9$') AND area <> 'CHINA' AND balance >= 0 AND ((pe > 0 AND pe <= 25 AND pb > 0 AND pb <= 8) OR (pe IS NULL AND pb > 0 AND pb <= 8))")
def flt_tier1(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir).where(~_c("name").rlike("9$") & (_c("area") != "CHINA") & (_c("balance") >= 0) & (_c("pb") > 0) & (_c("pb") <= 8))
    t = t.where(_c("pe").isNull() | ((_c("pe") > 0) & (_c("pe") <= 25)))
    return t.select("code", F.when(_c("pe").isNull(), "observation").otherwise("main").alias("channel"))


@query(f"WITH {LATEST} SELECT c_custkey AS code FROM customer LEFT JOIN lo ON o_custkey = c_custkey WHERE NOT coalesce(o_totalprice > 300000, false) AND NOT coalesce(o_orderpriority = '1-URGENT', false)")
def flt_veto(spark, sf_dir):
    t = table(spark, sf_dir, "customer").join(_latest_orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left")
    bad = F.coalesce(_c("o_totalprice") > 300000, F.lit(False)) | F.coalesce(_c("o_orderpriority") == "1-URGENT", F.lit(False))
    return t.where(~bad).select(_c("c_custkey").alias("code"))


@query(f"WITH {BARS}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pre_close FROM bars) SELECT symbol, trade_date, close - pre_close AS change, CASE WHEN pre_close > 0 THEN (close - pre_close) / pre_close * 100 END AS pct_chg FROM p")
def prj_std_record(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    t = weekly_brand_bars(spark, sf_dir).withColumn("pre_close", F.lag("close").over(w))
    change = _c("close") - _c("pre_close")
    return t.select("symbol", "trade_date", change.alias("change"), F.when(_c("pre_close") > 0, F.try_divide(change, _c("pre_close")) * 100).alias("pct_chg"))


@query(f"WITH {SNAPSHOT} SELECT code, name, CAST(NULL AS DOUBLE) AS ma20, total_mv / 10000 AS total_mv FROM snap")
def prj_format(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).select("code", "name", F.lit(None).cast("double").alias("ma20"), (_c("total_mv") / 10000).alias("total_mv"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_left_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(_orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query(f"WITH {LATEST} SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN lo ON o_custkey = c_custkey")
def join_left_latest(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(_latest_orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query(f"""WITH {LATEST} SELECT c_custkey, c_name, n_name, c_mktsegment, c_acctbal, o_orderkey, o_orderdate, o_totalprice
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN lo ON o_custkey = c_custkey
    WHERE c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') ORDER BY c_acctbal DESC, c_custkey LIMIT 50""")
def join_screen_view(spark, sf_dir):
    """The flagship: predicates reach the customer scan, the latest order of each customer is joined, the top 50 returned."""
    cust = table(spark, sf_dir, "customer")
    keep = screen.flat([{"field": "c_acctbal", "operator": "between", "value": [0, 5000]}, {"field": "c_mktsegment", "operator": "in", "value": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}], set(cust.columns))
    nation = table(spark, sf_dir, "nation")
    t = cust.where(keep).join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    # The page is cut before the orders are joined: they add no row and the order doesn't depend on them.
    top = screen.page(t, [("c_acctbal", "desc")], 50, tie="c_custkey")
    mine = _orders(spark, sf_dir).join(F.broadcast(top.select(_c("c_custkey").alias("k"))), F.col("o_custkey") == F.col("k"), "left_semi")
    last = rel.latest(mine, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    out = top.join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", "c_name", "n_name", "c_mktsegment", "c_acctbal", "o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("SELECT p_partkey, sum(l_quantity) AS qty FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 40 GROUP BY 1")
def join_inner(spark, sf_dir):
    t = table(spark, sf_dir, "part").where("p_size > 40").join(table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey"))
    return t.groupBy("p_partkey").agg(F.sum("l_quantity").alias("qty"))


@query(f"WITH {SNAPSHOT}, {LATEST} SELECT code, coalesce(CASE WHEN balance > 0 THEN balance END, o_totalprice) AS roe FROM snap LEFT JOIN lo ON o_custkey = code")
def join_enrich_fin(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir).join(_latest_orders(spark, sf_dir), F.col("o_custkey") == F.col("code"), "left")
    return t.select("code", F.coalesce(F.when(_c("balance") > 0, _c("balance")), _c("o_totalprice")).alias("roe"))


@query(f"WITH {SNAPSHOT}, {LATEST} SELECT lpad(code::VARCHAR, 6, '0') AS code, coalesce(o_totalprice, balance) AS close FROM snap LEFT JOIN lo ON lpad(o_custkey::VARCHAR, 6, '0') = lpad(code::VARCHAR, 6, '0')")
def join_enrich_quotes(spark, sf_dir):
    pad = lambda c: F.lpad(_c(c).cast("string"), 6, "0")
    t = customer_snapshot(spark, sf_dir).withColumn("c6", pad("code"))
    q = _latest_orders(spark, sf_dir).withColumn("q6", pad("o_custkey"))
    return t.join(q, F.col("c6") == F.col("q6"), "left").select(_c("c6").alias("code"), F.coalesce("o_totalprice", "balance").alias("close"))


@query("""SELECT ts::DATE AS day, max(CASE WHEN event_type = 'click' THEN n END) AS click, max(CASE WHEN event_type = 'view' THEN n END) AS view, max(CASE WHEN event_type = 'purchase' THEN n END) AS purchase
    FROM (SELECT ts::DATE AS ts, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def join_source_compare(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return t.groupBy("day").pivot("event_type", ["click", "view", "purchase"]).agg(F.max("n"))


_YEARS = "y AS (SELECT o_custkey AS code, year(o_orderdate) AS yr, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)"


def _yearly(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir).groupBy(_c("o_custkey").alias("code"), F.year("o_orderdate").alias("yr")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


@query(f"WITH {_YEARS} SELECT a.code, a.yr, a.v - b.v AS change FROM y a JOIN y b ON a.code = b.code AND b.yr = a.yr - 1")
def join_year_align(spark, sf_dir):
    y = _yearly(spark, sf_dir)
    before = y.select("code", (_c("yr") + 1).alias("yr"), _c("v").alias("v0"))
    return y.join(before, ["code", "yr"]).select("code", "yr", (_c("v") - _c("v0")).alias("change"))


@query("SELECT DISTINCT year(o_orderdate) AS yr FROM orders INTERSECT SELECT DISTINCT year(l_shipdate) FROM lineitem")
def join_year_intersect(spark, sf_dir):
    # Years alone are shuffled. intersect() is planned as a semi join of all orders, from before their repeats go.
    years = lambda t, day: t.select(F.year(day).alias("yr")).distinct()
    both = years(_orders(spark, sf_dir), "o_orderdate").union(years(table(spark, sf_dir, "lineitem"), "l_shipdate"))
    return both.groupBy("yr").agg(F.count("*").alias("n")).where("n = 2").select("yr")


@query("SELECT c_custkey AS code FROM customer INTERSECT SELECT s_suppkey FROM supplier")
def join_common_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(_c("c_custkey").alias("code")).intersect(table(spark, sf_dir, "supplier").select(_c("s_suppkey").alias("code")))


@query(f"WITH {LATEST} SELECT c_custkey AS code, c_acctbal * coalesce(o_totalprice, s_acctbal, 1) AS value FROM customer LEFT JOIN lo ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey")
def join_positions_price(spark, sf_dir):
    t = table(spark, sf_dir, "customer").join(_latest_orders(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"), "left")
    t = t.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left")
    return t.select(_c("c_custkey").alias("code"), (_c("c_acctbal") * F.coalesce("o_totalprice", "s_acctbal", F.lit(1.0))).alias("value"))


@query(f"WITH {BARS} SELECT symbol, year(trade_date) AS yr, arg_max(close, trade_date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2")
def join_year_end_price(spark, sf_dir):
    return weekly_brand_bars(spark, sf_dir).groupBy("symbol", F.year("trade_date").alias("yr")).agg(F.max_by("close", "trade_date").alias("close"), F.sum("volume").alias("volume"))


@query(f"WITH {BARS} SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.trade_date, b.trade_date) AS trade_date, a.close AS x, b.close AS y FROM (SELECT * FROM bars WHERE volume > 100) a FULL JOIN (SELECT * FROM bars WHERE volume < 150) b ON a.symbol = b.symbol AND a.trade_date = b.trade_date")
def join_panel_align(spark, sf_dir):
    t = weekly_brand_bars(spark, sf_dir)
    a = t.where("volume > 100").select("symbol", "trade_date", _c("close").alias("x"))
    return a.join(t.where("volume < 150").select("symbol", "trade_date", _c("close").alias("y")), ["symbol", "trade_date"], "full")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(_orders(spark, sf_dir).where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(_orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# --- aggregations ----------------------------------------------------------------------------------------------------


@query("SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(avg(c_acctbal), 2) AS mean, count(c_acctbal) AS n FROM customer")
def agg_field_stats(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.round(F.avg("c_acctbal"), 2).alias("mean"), F.count("c_acctbal").alias("n"))


@query("SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL ORDER BY p_type LIMIT 4")
def agg_distinct_vals(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_type is not null").select("p_type").distinct().orderBy("p_type").limit(4)


@query("SELECT c_mktsegment AS industry, count(*) AS n FROM customer WHERE c_mktsegment <> '' GROUP BY 1")
def agg_industries(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment <> ''").groupBy(_c("c_mktsegment").alias("industry")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "industry")


@query("SELECT n_name AS market, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def agg_market_overview(spark, sf_dir):
    t = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return t.groupBy(_c("n_name").alias("market")).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))


@query("SELECT count(*) AS n, count(*) FILTER (value > 50) AS high, count(*) FILTER (value <= 50 AND value > 10) AS mid, count(*) FILTER (value <= 10) AS low, count(*) FILTER (event_type = 'click') AS clicks FROM events")
def agg_news_stats(spark, sf_dir):
    v = _c("value")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(v > 50).alias("high"), F.count_if((v <= 50) & (v > 10)).alias("mid"), F.count_if(v <= 10).alias("low"), F.count_if(_c("event_type") == "click").alias("clicks"))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS views, round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS mean, count(*) FILTER (value > 20) AS hot FROM events GROUP BY 1")
def agg_social_stats(spark, sf_dir):
    t = table(spark, sf_dir, "events").withColumn("engagement", F.from_json("props", "k long"))
    return t.groupBy("event_type").agg(F.sum("engagement.k").alias("views"), F.round(F.avg("engagement.k"), 6).alias("mean"), F.count_if(_c("value") > 20).alias("hot"))


@query("SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def agg_internal_stats(spark, sf_dir):
    return rel.histogram(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT event_type, count(*) AS n, max(ts) AS newest, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_hist_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("newest"), F.countDistinct("user_id").alias("users"))


@query("SELECT o_orderstatus AS period, o_orderpriority AS source, count(*) AS n, max(o_orderdate) AS newest FROM orders GROUP BY 1, 2")
def agg_period_stats(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy(_c("o_orderstatus").alias("period"), _c("o_orderpriority").alias("source")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))


@query("SELECT o_orderpriority AS source, count(*) AS n, max(o_orderdate) AS newest, count(DISTINCT o_custkey) AS symbols, (SELECT count(DISTINCT o_custkey) FROM orders) AS all_symbols FROM orders GROUP BY 1")
def agg_fin_stats(spark, sf_dir):
    t = _orders(spark, sf_dir)
    by = t.groupBy(_c("o_orderpriority").alias("source")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"), F.countDistinct("o_custkey").alias("symbols"))
    whole = t.agg(F.countDistinct("o_custkey").alias("all_symbols"))
    return by.join(F.broadcast(whole), F.lit(True))  # one row


@query("SELECT h.h AS hour, count(event_id) AS n, count(event_id) FILTER (value > 50) AS ok FROM (SELECT unnest(range(24)) AS h) h LEFT JOIN events ON hour(ts) = h.h GROUP BY 1")
def agg_log_stats(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(_c("value") > 50).alias("ok"))
    hours = spark.range(24).select(_c("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(by), "hour", "left").fillna(0, ["n", "ok"])  # 24 rows at most


@query("SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean, max(o_orderdate) AS last FROM orders GROUP BY 1")
def agg_job_stats(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy(_c("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_orderdate").alias("last"))


@query("SELECT event_type, (user_id % 5)::VARCHAR AS model, ts::DATE AS day, count(*) AS n, round(sum(value), 4) AS cost FROM events GROUP BY GROUPING SETS ((event_type), ((user_id % 5)::VARCHAR), (ts::DATE), ())")
def agg_usage(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_type", (_c("user_id") % 5).cast("string").alias("model"), F.to_date("ts").alias("day"), "value")
    sets = [[_c("event_type")], [_c("model")], [_c("day")], []]
    return t.groupingSets(sets, _c("event_type"), _c("model"), _c("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost"))


@query("SELECT ts::DATE AS day, round(sum(value), 4) AS cost, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens FROM events GROUP BY 1")
def agg_usage_daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("cost"), F.sum(F.from_json("props", "k long")["k"]).alias("tokens"))


@query("SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS tag FROM part")
def agg_user_tags(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("tag")).distinct()


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS bought FROM events WHERE event_type = 'purchase' AND ts::DATE = DATE '2024-01-10' GROUP BY 1")
def agg_today_buys(spark, sf_dir):
    t = table(spark, sf_dir, "events").where((_c("event_type") == "purchase") & (_c("ts") >= F.lit("2024-01-10").cast("timestamp")) & (_c("ts") < F.lit("2024-01-11").cast("timestamp")))
    return t.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("bought"))


@query("SELECT round(avg(c_acctbal), 6) AS a, round(avg(s_acctbal), 6) AS b, round(abs(avg(c_acctbal) - avg(s_acctbal)) / nullif(abs(avg(c_acctbal)), 0), 6) AS diff FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_acctbal <> 0 AND s_acctbal <> 0")
def agg_consistency(spark, sf_dir):
    t = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c_custkey")).where("c_acctbal <> 0 and s_acctbal <> 0")
    a, b = F.avg("c_acctbal"), F.avg("s_acctbal")
    return t.agg(F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(F.try_divide(F.abs(a - b), F.abs(a)), 6).alias("diff"))


@query("""SELECT user_id, count(*) AS n, max(ts::DATE) AS newest, count(*) FILTER (gap > 3) AS gaps, count(*) < 15 OR count(*) FILTER (gap > 3) > 0.1 * count(*) AS incomplete
    FROM (SELECT *, date_diff('day', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM (SELECT DISTINCT user_id, ts::DATE AS ts FROM events)) GROUP BY 1""")
def agg_completeness(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d")).distinct()
    t = t.withColumn("gap", F.datediff(F.lead("d").over(Window.partitionBy("user_id").orderBy("d")), "d"))
    n, gaps = F.count("*"), F.count_if(_c("gap") > 3)
    return t.groupBy("user_id").agg(n.alias("n"), F.max("d").alias("newest"), gaps.alias("gaps"), ((n < 15) | (gaps > 0.1 * n)).alias("incomplete"))


@query(f"""WITH {TYPE_BARS} SELECT symbol, week, arg_min(open, trade_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, trade_date) AS close, sum(volume)::BIGINT AS volume, round(sum(amount), 3) AS amount
    FROM (SELECT *, (trade_date + ((5 - isodow(trade_date) + 7) % 7)::INTEGER) AS week FROM tbars) GROUP BY 1, 2""")
def agg_resample_week(spark, sf_dir):
    t = daily_type_bars(spark, sf_dir).withColumn("week", F.next_day(F.date_sub("trade_date", 1), "FRI"))
    return t.groupBy("symbol", "week").agg(F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"), F.sum("volume").alias("volume"), F.round(F.sum("amount"), 3).alias("amount"))


@query(f"WITH {BARS} SELECT symbol, year(trade_date) AS yr, max(high) AS high, min(low) AS low, arg_max(close, trade_date) AS last, round(avg(volume), 6) AS volume FROM bars GROUP BY 1, 2")
def agg_annual_hilo(spark, sf_dir):
    return weekly_brand_bars(spark, sf_dir).groupBy("symbol", F.year("trade_date").alias("yr")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("last"), F.round(F.avg("volume"), 6).alias("volume"))


@query(f"WITH {_YEARS} SELECT code, yr, v FROM y")
def agg_annual_div(spark, sf_dir):
    return _yearly(spark, sf_dir)


@query("""SELECT code, arg_min(m, (-n, m)) AS month FROM (SELECT o_custkey AS code, month(o_orderdate) AS m, count(DISTINCT year(o_orderdate)) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def agg_fy_month(spark, sf_dir):
    t = _orders(spark, sf_dir).groupBy(_c("o_custkey").alias("code"), F.month("o_orderdate").alias("m")).agg(F.countDistinct(F.year("o_orderdate")).alias("n"))
    return t.groupBy("code").agg(F.max_by("m", F.struct("n", -_c("m"))).alias("month"))


@query("SELECT o_custkey AS code, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS p FROM orders GROUP BY 1")
def agg_pivot_items(spark, sf_dir):
    t = _orders(spark, sf_dir).withColumn("k", F.lower("o_orderstatus"))
    return t.groupBy(_c("o_custkey").alias("code")).pivot("k", ["f", "o", "p"]).agg(F.round(F.sum("o_totalprice"), 2))


@query("SELECT p_brand, median(p_retailprice) AS med FROM part GROUP BY 1")
def agg_median(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.median("p_retailprice").alias("med"))


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.25), 6) AS p25, round(quantile_cont(p_retailprice, 0.75), 6) AS p75 FROM part GROUP BY 1")
def agg_pctl_linear(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.25), 6).alias("p25"), F.round(F.percentile("p_retailprice", 0.75), 6).alias("p75"))


@query("SELECT p_brand, list_sort(list(p_retailprice))[1 + floor(0.3::DOUBLE * (count(*) - 1))::INTEGER] AS p30 FROM part GROUP BY 1")
def agg_pctl_floor(spark, sf_dir):
    return rel.order_statistics(table(spark, sf_dir, "part").select("p_brand", "p_retailprice"), "p_brand", "p_retailprice", {"p30": 30})


@query(f"WITH {BARS}, c AS (SELECT symbol, arg_max(close, trade_date) AS cur FROM bars GROUP BY 1) SELECT symbol, round(100.0::DOUBLE * count(*) FILTER (close < cur) / count(*), 6) AS pct FROM bars JOIN c USING (symbol) GROUP BY 1")
def agg_pct_below(spark, sf_dir):
    t = weekly_brand_bars(spark, sf_dir)
    cur = t.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("cur"))
    return t.join(cur, "symbol").groupBy("symbol").agg(F.round(100.0 * F.count_if(_c("close") < _c("cur")) / F.count("*"), 6).alias("pct"))


@query(f"WITH {_YEARS} SELECT code, CASE WHEN count(*) > 1 THEN round(pow(arg_max(v, yr) / arg_min(v, yr), 1.0::DOUBLE / (count(*) - 1)) - 1, 7) END AS cagr FROM y WHERE v > 0 GROUP BY 1")
def agg_cagr(spark, sf_dir):
    n = F.count("*")
    growth = F.pow(F.try_divide(F.max_by("v", "yr"), F.min_by("v", "yr")), F.try_divide(F.lit(1.0), n - 1)) - 1
    return _yearly(spark, sf_dir).where("v > 0").groupBy("code").agg(F.when(n > 1, F.round(growth, 7)).alias("cagr"))


@query(f"WITH {_YEARS} SELECT code, round(stddev_pop(v) / nullif(avg(v), 0), 7) AS cv_pop, round(stddev_samp(v) / nullif(avg(v), 0), 7) AS cv_samp FROM y GROUP BY 1")
def agg_cv(spark, sf_dir):
    return _yearly(spark, sf_dir).groupBy("code").agg(F.round(F.try_divide(F.stddev_pop("v"), F.avg("v")), 7).alias("cv_pop"), F.round(F.try_divide(F.stddev_samp("v"), F.avg("v")), 7).alias("cv_samp"))


# --- windows, orders, sets -------------------------------------------------------------------------------------------


@query(f"WITH {LATEST} SELECT o_custkey, o_orderkey FROM lo")
def win_latest_per_key(spark, sf_dir):
    return _latest_orders(spark, sf_dir).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (month(o_orderdate) = 12)::INTEGER DESC, o_orderdate DESC, o_orderkey DESC) = 1")
def win_latest_annual(spark, sf_dir):
    return rel.latest(_orders(spark, sf_dir), ["o_custkey"], [F.desc(F.month("o_orderdate") == 12), F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(f"WITH {_YEARS} SELECT code, yr, v FROM y QUALIFY row_number() OVER (PARTITION BY code ORDER BY yr DESC) <= 5")
def win_annual_topk(spark, sf_dir):
    return rel.top_per_key(_yearly(spark, sf_dir), ["code"], [F.desc("yr")], 5)


@query(f"""WITH {SNAPSHOT} SELECT code, (rank() OVER (ORDER BY pe NULLS LAST) + (count(*) OVER (PARTITION BY pe) - 1) / 2.0::DOUBLE) / count(*) OVER () AS up,
    1 - (rank() OVER (ORDER BY pe NULLS FIRST) + (count(*) OVER (PARTITION BY pe) - 1) / 2.0::DOUBLE) / count(*) OVER () AS down FROM snap""")
def win_pct_rank(spark, sf_dir):
    """Missing values score best in both directions."""
    t = rel.global_ranks(customer_snapshot(spark, sf_dir), "pe")
    up = rel.percentile(t, "pe", nulls_last=True)
    return t.select("code", up.alias("up"), (1 - rel.percentile(t, "pe", nulls_last=False)).alias("down"))


@query(f"WITH {BARS}, d AS (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS dd FROM bars) SELECT symbol, -min(dd) AS drawdown, arg_min(trade_date, (dd, trade_date)) AS trough FROM d GROUP BY 1")
def win_drawdown_loc(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    t = weekly_brand_bars(spark, sf_dir).withColumn("dd", F.try_divide(_c("close"), F.max("close").over(w)) - 1)
    return t.groupBy("symbol").agg((-F.min("dd")).alias("drawdown"), F.min_by("trade_date", F.struct("dd", "trade_date")).alias("trough"))


@query("SELECT user_id, d, nxt FROM (SELECT user_id, d, lead(d) OVER (PARTITION BY user_id ORDER BY d) AS nxt FROM (SELECT DISTINCT user_id, ts::DATE AS d FROM events)) WHERE date_diff('day', d, nxt) > 3")
def win_gap(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d")).distinct()
    return t.withColumn("nxt", F.lead("d").over(Window.partitionBy("user_id").orderBy("d"))).where(F.datediff("nxt", "d") > 3)


@query(f"WITH {_YEARS} SELECT code, yr FROM (SELECT *, lag(v) OVER (PARTITION BY code ORDER BY yr) AS p FROM y) WHERE abs(v / nullif(p, 0) - 1) > 3")
def win_yoy_warn(spark, sf_dir):
    w = Window.partitionBy("code").orderBy("yr")
    t = _yearly(spark, sf_dir).withColumn("p", F.lag("v").over(w))
    return t.where(F.abs(F.try_divide(_c("v"), _c("p")) - 1) > 3).select("code", "yr")


@query(f"WITH {SNAPSHOT} SELECT code, total_mv, pe FROM snap ORDER BY total_mv DESC NULLS LAST, pe ASC NULLS LAST, code LIMIT 30 OFFSET 10")
def top_db_order(spark, sf_dir):
    return screen.page(customer_snapshot(spark, sf_dir), [("total_mv", "desc"), ("nope", "asc"), ("pe", "asc")], 30, 10).select("code", "total_mv", "pe")


@query(f"WITH {SNAPSHOT} SELECT code, pe FROM snap ORDER BY pe DESC NULLS FIRST, code LIMIT 25")
def top_tree_order(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).orderBy(_c("pe").desc_nulls_first(), "code").limit(25).select("code", "pe")


@query(f"""WITH {SNAPSHOT}, m AS (SELECT * FROM snap WHERE pe > 0 AND pb > 0), x AS (SELECT max(balance) AS b, max(1 / pe) AS e, max(1 / pb) AS p FROM m)
    SELECT code, round(0.4::DOUBLE * balance / b + 0.3::DOUBLE * (1 / pe) / e + 0.3::DOUBLE * (1 / pb) / p, 7) AS score FROM m, x ORDER BY score DESC, code LIMIT 150""")
def top_tier1(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir).where("pe > 0 and pb > 0")
    best = t.agg(F.max("balance").alias("b"), F.max(1 / _c("pe")).alias("e"), F.max(1 / _c("pb")).alias("p"))
    s = F.lit(0.4) * _c("balance") / _c("b") + F.lit(0.3) * (1 / _c("pe")) / _c("e") + F.lit(0.3) * (1 / _c("pb")) / _c("p")
    return t.join(F.broadcast(best), F.lit(True)).select("code", F.round(s, 7).alias("score")).orderBy(F.desc("score"), "code").limit(150)  # best is one row


@query(f"WITH {BARS}, m AS (SELECT *, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS m20, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS m5 FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1) SELECT symbol, m20, m5 FROM m WHERE m20 > -1 AND m5 IS NOT NULL ORDER BY m5 DESC, symbol LIMIT 5")
def top_momentum(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    back = lambda n: F.try_divide(_c("close"), F.lag("close", n).over(w)) - 1
    t = weekly_brand_bars(spark, sf_dir).withColumns({"m20": back(20), "m5": back(5)})
    last = rel.latest(t, ["symbol"], [F.desc("trade_date")]).where("m20 > -1 and m5 is not null")
    return last.orderBy(F.desc("m5"), "symbol").limit(5).select("symbol", "m20", "m5")


@query("SELECT code, name FROM (SELECT c_custkey AS code, c_name AS name, 1 AS p FROM customer UNION ALL SELECT s_suppkey, s_name, 0 FROM supplier) QUALIFY row_number() OVER (PARTITION BY code ORDER BY p) = 1 ORDER BY code LIMIT 20")
def top_dedup_source(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(_c("c_custkey").alias("code"), _c("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(_c("s_suppkey").alias("code"), _c("s_name").alias("name"))
    return rel.coalesce_sources([b, a], ["code"]).orderBy("code").limit(20)


@query(f"WITH {BARS}, n AS (SELECT symbol, trade_date, close, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS r, least(60, count(*) OVER (PARTITION BY symbol)) AS c FROM bars), l AS (SELECT *, c - r AS i, greatest(1, c // 12) AS step FROM n WHERE r <= 60) SELECT symbol, trade_date, close FROM l WHERE i % step = 0")
def top_sample_step(spark, sf_dir):
    w = Window.partitionBy("symbol")
    t = weekly_brand_bars(spark, sf_dir).withColumn("r", F.row_number().over(w.orderBy(F.desc("trade_date"))))
    t = t.withColumn("c", F.least(F.lit(60), F.count("*").over(w))).where("r <= 60")
    return t.where("(c - r) % greatest(1, c div 12) = 0").select("symbol", "trade_date", "close")


_HALVES = "a AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-03'), b AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-28')"


def _halves(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    return t.where(_c("ts") < F.lit("2024-01-03").cast("timestamp")), t.where(_c("ts") >= F.lit("2024-01-28").cast("timestamp"))


@query(f"WITH {_HALVES} SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'kept' END AS status FROM a FULL JOIN b ON a.user_id = b.user_id")
def set_changes(spark, sf_dir):
    return rel.set_changes(*_halves(spark, sf_dir), "user_id")


@query(f"WITH {_HALVES} SELECT user_id FROM a INTERSECT SELECT user_id FROM b")
def set_intersect(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return a.select("user_id").intersect(b.select("user_id"))


@query(f"WITH {_HALVES} SELECT user_id FROM a UNION SELECT user_id FROM b")
def set_union_distinct(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return a.select("user_id").union(b.select("user_id")).distinct()


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'P'")
def set_union_all(spark, sf_dir):
    t = _orders(spark, sf_dir)
    return t.where("o_orderstatus = 'F'").select(_c("o_orderkey").alias("k"), _c("o_totalprice").alias("v")).unionByName(t.where("o_orderstatus = 'P'").select(_c("o_orderkey").alias("k"), F.lit(0.0).alias("v")))


@query("SELECT o_orderkey AS k, o_totalprice AS v, CAST(NULL AS VARCHAR) AS note FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def set_concat_mixed(spark, sf_dir):
    t = _orders(spark, sf_dir)
    return t.where("o_orderstatus = 'F'").select(_c("o_orderkey").alias("k"), _c("o_totalprice").alias("v")).unionByName(t.where("o_orderstatus = 'P'").select(_c("o_orderkey").alias("k"), _c("o_orderpriority").alias("note")), allowMissingColumns=True)


@query("SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2")
def set_dedup(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return rel.latest(t, ["l_orderkey", "l_linenumber"], [F.desc("l_extendedprice")]).select("l_orderkey", "l_linenumber", _c("l_extendedprice").alias("price"))
