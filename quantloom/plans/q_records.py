"""Queries of statement sources, ledgers, scores out of texts, and small functions on words, times and prices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import scalar as sc
from quantloom.operators import backtest as bt
from quantloom.operators import derived as dv
from quantloom.operators import fundamentals as fm
from quantloom.operators import quant as qt
from quantloom.operators import relational as rel
from quantloom.operators import text as tx
from quantloom.sources.bars import BARS, table, weekly_brand_bars

from .q_models import _SCORE, _SENT, _scored
from .q_screener import MARKET, STATEMENTS, _dps, _orders, _valuation, _vetoes, statements

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


# Statement sources: columns from candidate lists, of which the first that holds a value counts; a column without any is null.
_SOURCES = {
    "src_income": {"revenue": ["total_revenue", "revenue"], "operate_profit": ["oper_profit"], "ebitda": ["ebitda_v", "oper_profit"], "n_income_attr_p": ["np_parent"]},
    "src_balancesheet": {"money_cap": ["cash"], "trad_asset": ["trad"], "net_debt": ["netdebt_v", "ibd"], "total_assets": ["total_assets"], "minority": ["minority_int"]},
    "src_cashflow": {"n_cashflow_act": ["ocf"], "capex": ["c_pay", "capex"], "free": ["fcff_v", "ocf"]},
    "src_fina_indicator": {"gross_margin": ["grossprofit_margin", "gross_margin"], "equity": ["bps", "equity"], "fcff": ["fcff_v"]},
}
_THERE = "revenue oper_profit np_parent ocf capex cash trad ibd total_assets gross_margin equity ebitda_v netdebt_v fcff_v".split()


def _source(mapping):
    def run(spark, sf_dir):
        t = statements(spark, sf_dir).withColumn("end_date", F.concat(_c("yr").cast("string"), F.lit("1231")))
        t = rel.pick(t, {"code": "code", "end_date": "end_date", **mapping})
        return t.select("code", "end_date", *[F.round(k, 4).alias(k) for k in mapping])

    def value(names):
        there = [n for n in names if n in _THERE]
        return f"round(coalesce({', '.join(there)}, NULL), 4)" if there else "NULL::DOUBLE"

    sql = f"WITH {STATEMENTS} SELECT code, yr::VARCHAR || '1231' AS end_date, " + ", ".join(f"{value(v)} AS {k}" for k, v in mapping.items()) + " FROM st"
    return run, sql


for _name, _mapping in _SOURCES.items():
    QUERIES[_name], ORACLES[_name] = _source(_mapping)


@query("SELECT o_custkey AS code, year(o_orderdate)::VARCHAR || '1231' AS end_date, round(sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 1000 / 10, 6) AS cash_div_tax FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, year(o_orderdate)")
def src_dividend(spark, sf_dir):
    """Dividends by share out of those for ten shares."""
    ten = _orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'").groupBy("code", "yr").agg((F.sum("c").cast("double") / 1000).alias("ten"))
    return ten.select("code", F.concat(_c("yr").cast("string"), F.lit("1231")).alias("end_date"), F.round(_c("ten") / 10, 6).alias("cash_div_tax"))


@query(f"WITH {MARKET} SELECT code, round(100 * (count(*) FILTER (o_orderpriority = '1-URGENT'))::DOUBLE / count(*), 6) AS pledge FROM oc GROUP BY 1")
def src_pledge(spark, sf_dir):
    return _vetoes(spark, sf_dir).select("code", F.round("pledge", 6).alias("pledge"))


@query(f"WITH {MARKET}, x AS (SELECT *, row_number() OVER (ORDER BY pledge DESC, code) AS r FROM (SELECT code, round(100 * (count(*) FILTER (o_orderpriority = '1-URGENT'))::DOUBLE / count(*), 6) AS pledge FROM oc GROUP BY 1)) SELECT code, pledge FROM x WHERE r <= 50")
def f_pledge(spark, sf_dir):
    return src_pledge(spark, sf_dir).orderBy(F.desc("pledge"), "code").limit(50)


@query(f"""WITH {MARKET}, v AS (SELECT c_custkey AS code, total_mv, pe_ttm, dv_ttm FROM customer LEFT JOIN val ON code = c_custkey), {STATEMENTS}, l AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY code ORDER BY yr DESC) = 1)
    SELECT v.code, round(coalesce(pe_ttm, CASE WHEN np_parent > 0 THEN total_mv / np_parent END), 6) AS pe, CASE WHEN abs(np_parent / CASE WHEN equity > 0 THEN equity END * 100) <= 200 THEN round(np_parent / CASE WHEN equity > 0 THEN equity END * 100, 6) END AS roe FROM v LEFT JOIN l ON l.code = v.code""")
def f_metrics(spark, sf_dir):
    """The quoted PE, or value over profit; the return on equity of the newest statement within 200 percent."""
    last = rel.latest(statements(spark, sf_dir).select("code", "yr", "np_parent", "equity"), ["code"], [F.desc("yr")])
    t = table(spark, sf_dir, "customer").select(_c("c_custkey").alias("code")).join(_valuation(spark, sf_dir), "code", "left").join(last, "code", "left")
    roe = _c("np_parent") / F.when(_c("equity") > 0, _c("equity")) * 100
    pe = F.coalesce("pe_ttm", _c("total_mv") / F.when(_c("np_parent") > 0, _c("np_parent")))
    return t.select("code", F.round(pe, 6).alias("pe"), F.when(F.abs(roe) <= 200, F.round(roe, 6)).alias("roe"))


# Profits of a quarter: orders that are closed count as losses, so that both signs occur.
_PROFIT = """qp AS (SELECT o_custkey AS code, year(o_orderdate) AS yr, quarter(o_orderdate) AS q, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * round(o_totalprice * 100)::BIGINT) AS p FROM orders GROUP BY 1, 2, 3),
    cum AS (SELECT code, yr, q, sum(p) OVER (PARTITION BY code, yr ORDER BY q)::DOUBLE AS v FROM qp),
    l AS (SELECT * FROM cum QUALIFY row_number() OVER (PARTITION BY code ORDER BY yr DESC, q DESC) = 1),
    tt AS (SELECT l.code, l.q, CASE WHEN l.q = 4 THEN l.v ELSE a.v + l.v - s.v END AS ttm FROM l LEFT JOIN cum s ON s.code = l.code AND s.yr = l.yr - 1 AND s.q = l.q LEFT JOIN cum a ON a.code = l.code AND a.yr = l.yr - 1 AND a.q = 4)"""


@query(f"WITH {_PROFIT} SELECT code, CASE WHEN q = 4 OR ttm > 0 THEN ttm / 100 END AS ttm FROM tt")
def f_ttm_b(spark, sf_dir):
    """Trailing profit: a computed one must be positive, while that of a whole year passes with any sign."""
    gain = F.when(_c("o_orderstatus") == "F", -1).otherwise(1) * F.round(_c("o_totalprice") * 100).cast("long")
    t = table(spark, sf_dir, "orders").groupBy(_c("o_custkey").alias("code"), F.year("o_orderdate").alias("yr"), F.quarter("o_orderdate").alias("q")).agg(F.sum(gain).alias("p"))
    w = Window.partitionBy("code", "yr").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    cum = t.select("code", "yr", "q", F.sum("p").over(w).cast("double").alias("v"))
    return fm.ttm(cum, "code", "yr", "q", "v", positive=True).select("code", (_c("ttm") / 100).alias("ttm"))


@query("SELECT c_mktsegment AS currency, round(sum(v) / 100, 2) AS value, round(sum(cash) / 100, 2) AS cash, round((sum(v) + sum(cash)) / 100, 2) AS equity FROM (SELECT c_mktsegment, c_custkey, round(c_acctbal * 100)::BIGINT AS cash FROM customer) LEFT JOIN (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def agg_positions_ccy(spark, sf_dir):
    """Value of what is held, cash and their sum by currency; an account is counted once."""
    held = _orders(spark, sf_dir).groupBy("code").agg(F.sum("c").alias("v"))
    t = table(spark, sf_dir, "customer").select(_c("c_custkey").alias("code"), _c("c_mktsegment").alias("currency"), F.round(_c("c_acctbal") * 100).cast("long").alias("cash"))
    t = t.join(held, "code", "left").groupBy("currency").agg(F.sum("v").alias("v"), F.sum("cash").alias("cash"))
    return t.select("currency", F.round(_c("v") / 100, 2).alias("value"), F.round(_c("cash") / 100, 2).alias("cash"), F.round((_c("v") + _c("cash")) / 100, 2).alias("equity"))


_DOWN = lambda x, n: f"((({x}) - ((({x}) % {n}) + {n}) % {n}) // {n})"
_NEAR = lambda x, n: _DOWN(f"2 * ({x}) + {n}", f"(2 * {n})")
CASH, UNIT = 50_000_000, 10_000_000


@query(f"""WITH RECURSIVE o AS (SELECT o_custkey AS code, o_orderstatus <> 'F' AS buy, round(o_totalprice * 100)::BIGINT AS p, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 100)::BIGINT * 278 ELSE 0 END AS fee, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    f AS (SELECT code, 0::BIGINT AS i, {CASH}::BIGINT * {UNIT} AS cash, 0::BIGINT AS held, 0::BIGINT AS cost, 0::BIGINT AS pnl, 0::BIGINT AS filled, 0::BIGINT AS refused FROM (SELECT DISTINCT code FROM o)
     UNION ALL SELECT code, nxt, CASE WHEN ok AND buy THEN {_NEAR(f"cash - p * {UNIT} - fee", UNIT)} * {UNIT} WHEN ok THEN cash + p * {UNIT} - fee ELSE cash END,
      CASE WHEN ok AND buy THEN held + 100 WHEN ok THEN held - 100 ELSE held END,
      CASE WHEN ok AND buy THEN {_DOWN("2 * (cost * held + p * 100) + held + 100", "(2 * (held + 100))")} WHEN (CASE WHEN ok THEN held - 100 ELSE held END) = 0 THEN 0 ELSE cost END,
      pnl + CASE WHEN ok AND NOT buy THEN p - cost ELSE 0 END, filled + CASE WHEN ok THEN 1 ELSE 0 END, refused + CASE WHEN ok THEN 0 ELSE 1 END
      FROM (SELECT f.*, o.i AS nxt, o.buy, o.p, o.fee, CASE WHEN o.buy THEN f.cash >= o.p * {UNIT} + o.fee ELSE f.held >= 100 END AS ok FROM f JOIN o ON o.code = f.code AND o.i = f.i + 1))
    SELECT code, cash, held, cost, pnl, filled, refused FROM f QUALIFY row_number() OVER (PARTITION BY code ORDER BY i DESC) = 1""")
def paper_order(spark, sf_dir):
    """Accounts after all of their orders of a hundred shares, filled or refused in the order of their dates."""
    sale, price = _c("o_orderstatus") == "F", F.round(_c("o_totalprice") * 100).cast("long")
    t = table(spark, sf_dir, "orders").select(
        _c("o_custkey").alias("code"), "o_orderdate", "o_orderkey", (~sale).alias("buy"), F.lit(100).cast("long").alias("qty"), price.alias("price"), F.when(sale, price * 278).otherwise(0).cast("long").alias("fee")
    )
    return bt.ledger(t, "code", ["o_orderdate", "o_orderkey"], CASH)


_CLS = f"(({_SENT}) + 1) * 50"
_COS = "list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(e::DOUBLE[], e::DOUBLE[])) * 100"
_COMBINED = f"""q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, {_COS} AS s FROM embeddings, q),
    c AS (SELECT doc_id, round({_SCORE} * 0.4::DOUBLE + coalesce(s, 0) * 0.35::DOUBLE + {_CLS} * 0.25::DOUBLE, 6) AS score FROM documents LEFT JOIN v ON vec_id = doc_id)"""


def _combined(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    phrase = vectors.where("vec_id = 0").select("embedding").first()
    near = vectors.select(_c("vec_id").alias("doc_id"), dv.best_cosine(_c("embedding"), [list(phrase[0])]).alias("s")) if phrase else vectors.select(_c("vec_id").alias("doc_id"), F.lit(None).cast("double").alias("s")).limit(0)
    mood = (tx.lexicon_sentiment(_c("text"), ["the", "und"], ["loser", "trash", "que"]) + 1) * 50
    t = _scored(spark, sf_dir).select("doc_id", "score").join(table(spark, sf_dir, "documents").select("doc_id", mood.alias("mood")), "doc_id").join(near, "doc_id", "left")
    return t.select("doc_id", F.round(dv.combined_score(_c("score"), _c("s"), _c("mood")), 6).alias("score"))


@query(f"WITH {_COMBINED} SELECT doc_id, score FROM c")
def nlp_combined(spark, sf_dir):
    """A text's rule score, its vector's cosine to a phrase and its sentiment as a share, weighed."""
    return _combined(spark, sf_dir)


@query(f"WITH {_COMBINED} SELECT doc_id, score FROM c WHERE score >= 40")
def nlp_combined_filter(spark, sf_dir):
    return _combined(spark, sf_dir).where("score >= 40").orderBy(F.desc("score"), "doc_id")


_PARTS = f"""p AS (SELECT lang, avg({_SENT}) AS s, least(count(*) / 100.0::DOUBLE, 1) AS c FROM documents GROUP BY 1),
    u AS (SELECT lang, avg(CASE WHEN contains(text, '!') THEN 1 ELSE -1 END) AS s, least((count(*) FILTER (contains(text, '!'))) / 50.0::DOUBLE, 1) AS c FROM documents GROUP BY 1),
    g AS (SELECT lang, avg(CASE WHEN contains(lower(text), 'copyright') THEN -1 ELSE 0 END) AS s, (count(*) FILTER (contains(lower(text), 'copyright')))::DOUBLE / count(*) AS c FROM documents GROUP BY 1)"""


@query(f"""WITH {_PARTS}, o AS (SELECT lang, coalesce((p.s * p.c + u.s * u.c + g.s * g.c) / nullif(p.c + u.c + g.c, 0), 0) AS s FROM p JOIN u USING (lang) JOIN g USING (lang))
    SELECT lang, round(s, 6) AS s, CASE WHEN s > 0.3 THEN 'very_positive' WHEN s > 0.1 THEN 'positive' WHEN s > -0.1 THEN 'neutral' WHEN s > -0.3 THEN 'negative' ELSE 'very_negative' END AS level FROM o""")
def nlp_overall_sentiment(spark, sf_dir):
    """Three readings of a language's texts (words, exclamations, notices), weighed by their confidence."""
    loud, notice, n = _c("text").contains("!"), F.lower("text").contains("copyright"), F.count("*")
    t = table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.avg(tx.lexicon_sentiment(_c("text"), ["the", "und"], ["loser", "trash", "que"])).alias("s1"), F.least(n / 100.0, F.lit(1.0)).alias("c1"),
        F.avg(F.when(loud, 1).otherwise(-1)).alias("s2"), F.least(F.count_if(loud) / 50.0, F.lit(1.0)).alias("c2"),
        F.avg(F.when(notice, -1).otherwise(0)).alias("s3"), (F.count_if(notice).cast("double") / n).alias("c3"),
    )
    s = dv.overall_sentiment([(_c(f"s{i}"), _c(f"c{i}")) for i in (1, 2, 3)])
    return t.select("lang", F.round(s, 6).alias("s"), dv.sentiment_level(s).alias("level"))


_WORDS = [f"{a}{w.upper() if k % 2 else w}{b}" for k, w in enumerate([*sc.ACTIONS, "wait", ""]) for a, b in (("", ""), (" ", "  "))]
_LIST = ", ".join(f"'{w}'" for w in _WORDS)
_MAP = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sc.ACTIONS.items())


@query(f"SELECT o_orderkey AS k, CASE lower(trim(([{_LIST}])[1 + o_orderkey % {len(_WORDS)}])) {_MAP} ELSE 'hold' END AS action FROM orders")
def fn_action_map(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (1 + _c("o_orderkey") % len(_WORDS)).cast("int"))
    return table(spark, sf_dir, "orders").select(_c("o_orderkey").alias("k"), sc.action(word).alias("action"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN TIMESTAMP '2000-01-01' END::TIMESTAMP AS at FROM orders")
def fn_parse_dt(spark, sf_dir):
    k, d = _c("o_orderkey"), _c("o_orderdate")
    x = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 2, "some day")
    return table(spark, sf_dir, "orders").select(k.alias("k"), sc.parsed_time(x, F.lit("2000-01-01").cast("timestamp")).cast("timestamp_ntz").alias("at"))


@query("""WITH x AS (SELECT o_orderkey AS k, floor(o_totalprice)::DOUBLE AS p, (o_orderkey % 7)::DOUBLE AS g, ['buy', 'sell', 'hold'][1 + o_orderkey % 3] AS a FROM orders)
    SELECT k, CASE WHEN k % 5 = 0 THEN NULL WHEN a = 'hold' THEN p WHEN k % 5 = 1 AND g > 0 THEN round(p * (1 + CASE WHEN a = 'buy' THEN 1 ELSE -1 END * (g / 100)), 2) ELSE round(p * CASE WHEN a = 'buy' THEN 1.15::DOUBLE ELSE 0.95::DOUBLE END, 2) END AS price FROM x""")
def fn_price_guess(spark, sf_dir):
    k, p = _c("o_orderkey"), F.floor("o_totalprice").cast("string")
    text = F.when(k % 5 == 0, "nothing").when(k % 5 == 1, F.concat(F.lit("现价: ¥"), p, F.lit("，上涨 "), (k % 7).cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("股价："), p))
    act = F.element_at(F.array(F.lit("buy"), F.lit("sell"), F.lit("hold")), (1 + k % 3).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), sc.guessed_price(text, act).alias("price"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 2 THEN 'call' ELSE 'put' END AS kind FROM orders")
def q_opt_type(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in (" Call", "认购", "PUTS", "p")])
    return table(spark, sf_dir, "orders").select(_c("o_orderkey").alias("k"), qt.option_type(F.element_at(words, (1 + _c("o_orderkey") % 4).cast("int"))).alias("kind"))


@query(f"""WITH {BARS}, r AS (SELECT symbol, trade_date, close, row_number() OVER w AS i, max(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS top FROM bars WHERE close IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
    t AS (SELECT *, close / top - 1 AS d FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY close / top - 1, i) = 1)
    SELECT t.symbol, round(-min(t.d), 9) AS mdd, min(t.i) - min(r.i) AS duration, min(r.trade_date)::VARCHAR AS peak, min(t.trade_date)::VARCHAR AS trough FROM t JOIN r ON r.symbol = t.symbol AND r.close = t.top AND r.i <= t.i GROUP BY 1""")
def q_mdd_loc(spark, sf_dir):
    t = qt.drawdown_location(weekly_brand_bars(spark, sf_dir), "symbol", "trade_date", "close")
    return t.select("symbol", F.round("mdd", 9).alias("mdd"), _c("duration").cast("long").alias("duration"), _c("peak").cast("string").alias("peak"), _c("trough").cast("string").alias("trough"))


# Two flows have a rate in closed form: out first, back in after some periods without any.
@query("""WITH x AS (SELECT o_custkey AS code, min(round(o_totalprice * 100)::BIGINT) AS a, max(round(o_totalprice * 100)::BIGINT) AS b, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1)
    SELECT code, round(pow(b / a, 1.0::DOUBLE / (1 + n % 3)) - 1, 6) AS rate FROM x""")
def q_irr(spark, sf_dir):
    t = _orders(spark, sf_dir).groupBy("code").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("n")).where("n > 1")
    flow = lambda i, v: F.struct(i.cast("long").alias("i"), v.cast("double").alias("v"))
    gaps = F.transform(F.sequence(F.lit(1), (_c("n") % 3).cast("int") + 1), lambda i: flow(i, F.when(i == _c("n") % 3 + 1, _c("b")).otherwise(0)))
    flows = t.select("code", F.explode(F.concat(F.array(flow(F.lit(0), -_c("a"))), gaps)).alias("f")).select("code", "f.*")
    return qt.irr(flows, "code", "i", "v").select("code", F.round("rate", 6).alias("rate"))


@query("""WITH y AS (SELECT o_custkey AS code, year(o_orderdate) AS yr, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 1000000000 AS dps FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
    SELECT code, yr, holding, round(dps * (1 - tax / 100), 8) AS net FROM y, (VALUES ('over_1y', 0.0::DOUBLE), ('1m_1y', 10.0::DOUBLE), ('under_1m', 20.0::DOUBLE)) t(holding, tax)""")
def m_tax_net(spark, sf_dir):
    """Dividends after tax by how long a share was held."""
    rates = F.array(*[F.struct(F.lit(h).alias("holding"), F.lit(x).alias("tax")) for m, h, x in dv.DIVIDEND_TAX if m == "CN"])
    t = _dps(spark, sf_dir).select("code", "yr", "dps", F.explode(rates).alias("r"))
    return t.select("code", "yr", "r.holding", F.round(_c("dps") * (1 - _c("r.tax") / 100), 8).alias("net"))
