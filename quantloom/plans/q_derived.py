"""Queries of further derived metrics, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import derived as dv
from quantloom.operators import relational as rel
from quantloom.operators import screen
from quantloom.sources.bars import BARS, SNAPSHOT, TYPE_BARS, customer_snapshot, daily_type_bars, table, weekly_brand_bars

from .q_models import _YEAR, _quarters, _years

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


@query(f"WITH {TYPE_BARS} SELECT symbol, (trade_date + ((5 - isodow(trade_date) + 7) % 7)::INTEGER)::VARCHAR AS week, arg_max(close, trade_date) AS close FROM tbars GROUP BY 1, 2")
def src_weekly(spark, sf_dir):
    t = daily_type_bars(spark, sf_dir).withColumn("week", F.next_day(F.date_sub("trade_date", 1), "FRI"))
    return t.groupBy("symbol", _c("week").cast("string").alias("week")).agg(F.max_by("close", "trade_date").alias("close"))


@query("SELECT n_regionkey AS tenor, round(avg(s_acctbal) / 1000, 6) AS rate FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def src_yield(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), _c("n_nationkey") == _c("s_nationkey"))
    return t.groupBy(_c("n_regionkey").alias("tenor")).agg(F.round(F.avg("s_acctbal") / 1000, 6).alias("rate"))


@query("SELECT l_orderkey AS symbol, l_linenumber AS bar, max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2")
def src_factor_panel(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(_c("l_orderkey").alias("symbol"), _c("l_linenumber").alias("bar"))
    return t.agg(F.max("l_extendedprice").alias("close"))


@query(f"WITH {BARS} SELECT symbol, trade_date::VARCHAR AS trade_date, close FROM bars WHERE close IS NOT NULL AND symbol IN ('Brand#11', 'Brand#25')")
def src_backtest(spark, sf_dir):
    return weekly_brand_bars(spark, sf_dir).where(_c("symbol").isin("Brand#11", "Brand#25") & _c("close").isNotNull()).select("symbol", _c("trade_date").cast("string").alias("trade_date"), _c("close").try_cast("double").alias("close"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def flt_financial(spark, sf_dir):
    t = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return t.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, value FROM events WHERE user_id = 7 AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 25")
def flt_usage(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id = 7 and event_type = 'click'").orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "value")


@query(f"WITH {SNAPSHOT} SELECT code FROM snap WHERE NOT coalesce(pe < 10, false) AND NOT coalesce(pb < 1, false) AND NOT coalesce(balance > 9000, false)")
def flt_quality(spark, sf_dir):
    bad = lambda e: F.coalesce(e, F.lit(False))
    return customer_snapshot(spark, sf_dir).where(~bad(_c("pe") < 10) & ~bad(_c("pb") < 1) & ~bad(_c("balance") > 9000)).select("code")


@query(f"WITH {_YEAR}, t AS (SELECT * FROM ann QUALIFY row_number() OVER (PARTITION BY code ORDER BY yr DESC) <= 5) SELECT code, count(*) FILTER (rev > 200000) AS good FROM t GROUP BY 1 HAVING count(*) FILTER (rev > 200000) >= 2")
def flt_obs_quality(spark, sf_dir):
    t = rel.top_per_key(_years(spark, sf_dir), ["code"], [F.desc("yr")], 5)
    return t.groupBy("code").agg(F.count_if(_c("rev") > 200000).alias("good")).where("good >= 2")


@query(f"WITH {SNAPSHOT} SELECT code, industry FROM snap WHERE industry = 'BUILDING' ORDER BY code LIMIT 40 OFFSET 40")
def flt_stock_list(spark, sf_dir):
    return screen.page(customer_snapshot(spark, sf_dir).where("industry = 'BUILDING'"), [], 40, 40).select("code", "industry")


@query(f"WITH {SNAPSHOT} SELECT code, total_mv * CASE WHEN code % 3 = 0 THEN 10000 WHEN code % 3 = 1 THEN 1000000 ELSE 1 END AS cap FROM snap")
def m_mktcap(spark, sf_dir):
    market = F.when(_c("code") % 3 == 0, "CN").when(_c("code") % 3 == 1, "HK").otherwise("US")
    return customer_snapshot(spark, sf_dir).select("code", dv.market_cap(_c("total_mv"), market).alias("cap"))


@query(f"WITH {_YEAR} SELECT code, yr, CASE WHEN rev > 0 THEN round(n * 1000 / rev * 100, 6) END AS payout FROM ann")
def m_payout(spark, sf_dir):
    return _years(spark, sf_dir).select("code", "yr", F.round(dv.payout(_c("n") * 1000, _c("rev")), 6).alias("payout"))


@query(f"WITH {SNAPSHOT}, x AS (SELECT code, CASE WHEN pb < 1 THEN pb * 100 ELSE pb END AS v, pe FROM snap) SELECT code, CASE WHEN abs(v - pe) <= 0.2 * abs(pe) THEN v ELSE coalesce(pe, v) END AS payout FROM x")
def m_hk_payout(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).select("code", dv.checked_payout(_c("pb"), _c("pe")).alias("payout"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice + CASE WHEN coalesce(l_discount, 0) <> 0 THEN l_discount ELSE l_quantity END + l_tax + 1 AS w FROM lineitem")
def m_outflow(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", dv.outflow(_c("l_extendedprice"), _c("l_discount"), _c("l_quantity"), _c("l_tax"), F.lit(1.0)).alias("w"))


@query(f"WITH {SNAPSHOT}, a AS (SELECT unnest([1.0::DOUBLE, 0.9::DOUBLE, 0.81::DOUBLE, 0.729::DOUBLE]) AS k), b AS (SELECT unnest([0.9::DOUBLE, 0.8::DOUBLE, 0.7::DOUBLE]) AS m) SELECT code, k, m, balance * k * m AS value FROM snap, a, b")
def m_decline(spark, sf_dir):
    t = dv.grid(customer_snapshot(spark, sf_dir).select("code", "balance"), lambda k, m: _c("balance") * k * m, k=[1.0, 0.9, 0.81, 0.729], m=[0.9, 0.8, 0.7])
    return t.select("code", "k", "m", "value")


@query(f"WITH {BARS}, c AS (SELECT symbol, arg_max(close, trade_date) AS cur, list_sort(list(close)) AS xs, count(*) AS n FROM bars GROUP BY 1) SELECT symbol, cur, xs[1 + floor(0.25::DOUBLE * (n - 1))::INTEGER] AS p25, xs[1 + floor(0.75::DOUBLE * (n - 1))::INTEGER] AS p75 FROM c")
def m_pricepct(spark, sf_dir):
    t = weekly_brand_bars(spark, sf_dir).select("symbol", "trade_date", "close")
    now = t.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("cur"))
    return now.join(rel.order_statistics(t, "symbol", "close", {"p25": 25, "p75": 75}), "symbol")


@query(f"WITH {SNAPSHOT} SELECT code, CASE WHEN coalesce(pe BETWEEN 16 AND 1000, false) THEN pe ELSE pb END AS pe FROM snap")
def m_pe_fallback(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).select("code", F.when(F.coalesce(_c("pe").between(16, 1000), F.lit(False)), _c("pe")).otherwise(_c("pb")).alias("pe"))


@query(f"""WITH {_YEAR}, l AS (SELECT *, max(yr) FILTER (q = 4) OVER (PARTITION BY code) AS y4 FROM fin), r AS (SELECT *, dense_rank() OVER (PARTITION BY code ORDER BY CASE WHEN q = 4 THEN yr END DESC NULLS LAST) AS r FROM l)
    SELECT code, yr::VARCHAR || CASE WHEN q = 4 THEN '' WHEN q = 2 THEN 'H1' ELSE 'Q' || q END AS label, rev FROM r WHERE (q = 4 AND r <= 5) OR (q <> 4 AND yr > coalesce(y4, 0))""")
def f_income(spark, sf_dir):
    return dv.display_periods(_quarters(spark, sf_dir), "code", "yr", "q").select("code", "label", "rev")


@query(f"WITH {_YEAR} SELECT code, yr, rev - abs(n * 1000) AS fcf FROM ann QUALIFY row_number() OVER (PARTITION BY code ORDER BY yr DESC) <= 5")
def f_cashflow(spark, sf_dir):
    t = rel.top_per_key(_years(spark, sf_dir), ["code"], [F.desc("yr")], 5)
    return t.select("code", "yr", dv.owner_cash(_c("rev"), _c("n") * 1000).alias("fcf"))


@query(f"WITH {SNAPSHOT} SELECT code, 6 + CASE WHEN contains(industry, 'MACH') THEN 1.5 WHEN contains(industry, 'BUILD') THEN -0.5 ELSE 0 END::DOUBLE AS s FROM snap")
def f_score_growth(spark, sf_dir):
    s = 6 + F.when(_c("industry").contains("MACH"), 1.5).when(_c("industry").contains("BUILD"), -0.5).otherwise(0.0)
    return customer_snapshot(spark, sf_dir).select("code", s.alias("s"))


@query("WITH q AS (SELECT embedding AS e, vec_id AS k FROM embeddings WHERE vec_id IN (0, 1)) SELECT vec_id, round(max(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(e::DOUBLE[], e::DOUBLE[]))) * 100, 6) AS s FROM embeddings, q GROUP BY 1")
def nlp_semantic(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    phrases = [list(r[0]) for r in t.where("vec_id in (0, 1)").orderBy("vec_id").select("embedding").collect()]
    return t.select("vec_id", F.round(dv.best_cosine(_c("embedding"), phrases), 6).alias("s"))


@query("SELECT item_id AS id, text FROM benchmark UNION ALL SELECT (SELECT max(item_id) FROM benchmark) + row_number() OVER (ORDER BY conv_id, turn), text FROM conversations")
def nlp_memory_add(spark, sf_dir):
    old = table(spark, sf_dir, "benchmark").select(_c("item_id").alias("id"), "text")
    new = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return dv.appended(old, new, "id", "conv_id", [_c("turn")])


@query("SELECT c_mktsegment AS k, round(greatest(0, 1 - abs(avg(c_acctbal) - 4500) / 4500 / 0.1), 6) AS score, CASE WHEN greatest(0, 1 - abs(avg(c_acctbal) - 4500) / 4500 / 0.1) >= 0.8 THEN 'use_primary' WHEN greatest(0, 1 - abs(avg(c_acctbal) - 4500) / 4500 / 0.1) >= 0.6 THEN 'use_with_warning' WHEN greatest(0, 1 - abs(avg(c_acctbal) - 4500) / 4500 / 0.1) >= 0.3 THEN 'check' ELSE 'investigate' END AS action FROM customer GROUP BY 1")
def agg_consistency_score(spark, sf_dir):
    t = table(spark, sf_dir, "customer").groupBy(_c("c_mktsegment").alias("k")).agg(F.avg("c_acctbal").alias("m"))
    s = dv.consistency(F.abs(_c("m") - 4500) / 4500, 0.1)
    return t.select("k", F.round(s, 6).alias("score"), dv.action_band(s).alias("action"))


@query("SELECT doc_id, n FROM (SELECT doc_id, length(text) - length(replace(text, 'the', 'th')) AS n FROM documents) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 30")
def top_text(spark, sf_dir):
    n = F.length("text") - F.length(F.replace(_c("text"), F.lit("the"), F.lit("th")))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n")).where("n > 0").orderBy(F.desc("n"), "doc_id").limit(30)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE month(o_orderdate) = 12 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def win_annual_df(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").where(F.month("o_orderdate") == 12).withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")
