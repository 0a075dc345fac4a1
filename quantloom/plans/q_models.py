"""Queries of fundamental models and texts on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import fundamentals as fm
from quantloom.operators import relational as rel
from quantloom.operators import text as tx
from quantloom.sources.bars import SNAPSHOT, customer_snapshot, table

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


# Yearly figures of a company: a customer's orders, lines as costs.
_YEAR = """fin AS (SELECT o_custkey AS code, year(o_orderdate) AS yr, quarter(o_orderdate) AS q, round(sum(o_totalprice), 2) AS rev, count(*) AS n FROM orders GROUP BY 1, 2, 3),
 ann AS (SELECT code, yr, round(sum(rev), 2) AS rev, sum(n) AS n FROM fin GROUP BY 1, 2)"""


def _quarters(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return t.groupBy(_c("o_custkey").alias("code"), F.year("o_orderdate").alias("yr"), F.quarter("o_orderdate").alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("rev"), F.count("*").alias("n"))


def _years(spark, sf_dir):
    return _quarters(spark, sf_dir).groupBy("code", "yr").agg(F.round(F.sum("rev"), 2).alias("rev"), F.sum("n").alias("n"))


_R = "balance * 0.4::DOUBLE / nullif(total_mv, 0) * 100 * 20"


@query(f"WITH {SNAPSHOT} SELECT code, round({_R}, 6) AS r, CASE WHEN {_R} < 2 THEN 'below_rf' WHEN {_R} < 2 THEN 'fail' WHEN {_R} < 4 THEN 'marginal' ELSE 'pass' END AS class FROM snap")
def t_factor2(spark, sf_dir):
    r = fm.penetrating_return(_c("balance"), F.lit(0.4), _c("total_mv")) * 20
    return customer_snapshot(spark, sf_dir).select("code", F.round(r, 6).alias("r"), fm.return_class(r, 2.0).alias("class"))


@query(f"WITH {SNAPSHOT} SELECT code, round(list_avg(list_filter([pe::DOUBLE, CASE WHEN balance > 0 THEN pb END, total_mv / 100000], lambda x: x IS NOT NULL)), 9) AS floor FROM snap")
def t_floor(spark, sf_dir):
    f = fm.floor_price([_c("pe"), F.when(_c("balance") > 0, _c("pb")), _c("total_mv") / 100000])
    return customer_snapshot(spark, sf_dir).select("code", F.round(f, 9).alias("floor"))


def _rank_sql(x: str, nulls: str) -> str:
    return f"(rank() OVER (ORDER BY {x} NULLS {nulls}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"


@query(f"WITH {SNAPSHOT} SELECT code, round(0.6::DOUBLE * {_rank_sql('total_mv', 'LAST')} + 0.4::DOUBLE * (1 - {_rank_sql('pe', 'FIRST')}), 7) AS score FROM snap")
def t_rank(spark, sf_dir):
    t = rel.global_ranks(customer_snapshot(spark, sf_dir), "total_mv", "pe")
    s = 0.6 * rel.percentile(t, "total_mv", nulls_last=True) + 0.4 * (1 - rel.percentile(t, "pe", nulls_last=False))
    return t.select("code", F.round(s, 7).alias("score"))


@query(f"WITH {SNAPSHOT} SELECT code, round(total_mv / (total_mv + greatest(balance, 0)) * 0.08::DOUBLE + greatest(balance, 0) / (total_mv + greatest(balance, 0)) * 0.05::DOUBLE * 0.75::DOUBLE, 8) AS wacc FROM snap WHERE total_mv IS NOT NULL")
def v_wacc(spark, sf_dir):
    v = fm.wacc(1.0, 0.03, 0.05, _c("total_mv"), F.greatest(_c("balance"), F.lit(0.0)), F.lit(0.05), F.lit(0.25))
    return customer_snapshot(spark, sf_dir).where("total_mv is not null").select("code", F.round(v, 8).alias("wacc"))


def _dcf_sql(f: str, g1: str, g: str, rate: str) -> str:
    growth = [f"({g1} + ({g} - {g1}) * {i} / 4.0::DOUBLE)" for i in range(5)]
    f_at, terms = f"({f})", []
    for i, x in enumerate(growth):
        f_at = f"{f_at} * (1 + {x})"
        terms.append(f"{f_at} / pow(1 + {rate}, {i + 1})")
    return f"CASE WHEN {rate} > {g} THEN " + " + ".join(terms) + f" + {f_at} * (1 + {g}) / ({rate} - {g}) / pow(1 + {rate}, 5) END"


@query(f"WITH {SNAPSHOT} SELECT code, round({_dcf_sql('balance', '0.1::DOUBLE', '0.03::DOUBLE', '0.09::DOUBLE')}, 4) AS value FROM snap")
def v_dcf(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).select("code", F.round(fm.dcf_value(_c("balance"), F.lit(0.1), 0.03, F.lit(0.09)), 4).alias("value"))


@query(f"""WITH {SNAPSHOT}, s AS (SELECT unnest([-0.01::DOUBLE, 0::DOUBLE, 0.01::DOUBLE]) AS d_rate), g AS (SELECT unnest([0.02::DOUBLE, 0.03::DOUBLE, 0.12::DOUBLE]) AS growth)
    SELECT code, d_rate, growth, round({_dcf_sql('balance', '0.1::DOUBLE', 'growth', '(0.09::DOUBLE + d_rate)')}, 4) AS value FROM snap, s, g""")
def v_dcf_sensitivity(spark, sf_dir):
    value = lambda a, g: fm.dcf_value(_c("balance"), F.lit(0.1), g, F.lit(0.09 + a))
    t = fm.sensitivity(customer_snapshot(spark, sf_dir).select("code", "balance"), value, [-0.01, 0.0, 0.01], [0.02, 0.03, 0.12])
    return t.select("code", "d_rate", "growth", F.round("value", 4).alias("value"))


@query(f"WITH {SNAPSHOT} SELECT code, round(0.25::DOUBLE * ({_dcf_sql('balance', '0.02::DOUBLE', '0.02::DOUBLE', '0.1::DOUBLE')}) + 0.5::DOUBLE * ({_dcf_sql('balance', '0.08::DOUBLE', '0.03::DOUBLE', '0.09::DOUBLE')}) + 0.25::DOUBLE * ({_dcf_sql('balance', '0.15::DOUBLE', '0.03::DOUBLE', '0.09::DOUBLE')}), 4) AS value FROM snap")
def v_dcf_scen(spark, sf_dir):
    b = _c("balance")
    v = 0.25 * fm.dcf_value(b, F.lit(0.02), 0.02, F.lit(0.1)) + 0.5 * fm.dcf_value(b, F.lit(0.08), 0.03, F.lit(0.09)) + 0.25 * fm.dcf_value(b, F.lit(0.15), 0.03, F.lit(0.09))
    return customer_snapshot(spark, sf_dir).select("code", F.round(v, 4).alias("value"))


@query(f"WITH {SNAPSHOT} SELECT code, round(pb * 1.03::DOUBLE / (0.08::DOUBLE - 0.03::DOUBLE), 6) AS gordon, round({_dcf_sql('pb', '0.1::DOUBLE', '0.03::DOUBLE', '0.08::DOUBLE')}, 6) AS staged FROM snap")
def v_ddm(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).select("code", F.round(fm.gordon(_c("pb"), F.lit(0.03), 0.08), 6).alias("gordon"), F.round(fm.two_stage_ddm(_c("pb"), F.lit(0.1), 0.03, 0.08), 6).alias("staged"))


@query(f"""WITH {_YEAR}, p AS (SELECT code, rev / n / 9973 AS pe, rev, yr FROM ann) SELECT code, round(quantile_cont(pe, 0.25), 6) AS p25, round(median(pe), 6) AS med, round(quantile_cont(pe, 0.75), 6) AS p75
    FROM p WHERE pe > 0 AND pe < 100 GROUP BY 1 HAVING count(*) >= 3""")
def v_pe_band(spark, sf_dir):
    t = _years(spark, sf_dir).withColumn("pe", _c("rev") / _c("n") / 9973).where("pe > 0 and pe < 100")
    p = lambda q, name: F.round(F.percentile("pe", q), 6).alias(name)
    return t.groupBy("code").agg(p(0.25, "p25"), p(0.5, "med"), p(0.75, "p75"), F.count("*").alias("k")).where("k >= 3").drop("k")


_GROW = "pow(arg_max(rev, yr) / arg_min(rev, yr), 1.0::DOUBLE / nullif(count(*) - 1, 0)) - 1"


@query(f"WITH {_YEAR}, g AS (SELECT code, arg_max(rev, yr) AS eps, {_GROW} AS g FROM ann GROUP BY 1) SELECT code, CASE WHEN g > 0 THEN round(eps * least(g * 100, 80), 2) END AS price FROM g")
def v_peg(spark, sf_dir):
    g = F.pow(F.try_divide(F.max_by("rev", "yr"), F.min_by("rev", "yr")), F.try_divide(F.lit(1.0), F.count("*") - 1)) - 1
    t = _years(spark, sf_dir).groupBy("code").agg(F.max_by("rev", "yr").alias("eps"), g.alias("g"))
    return t.select("code", F.round(fm.peg_price(_c("eps"), _c("g")), 2).alias("price"))


@query(f"WITH {_YEAR}, m AS (SELECT code, median(rev / n) AS ps, arg_max(rev, yr) AS rev FROM ann GROUP BY 1) SELECT code, round(ps * rev / 1000000, 4) AS value FROM m")
def v_ps(spark, sf_dir):
    t = _years(spark, sf_dir).groupBy("code").agg(F.median(_c("rev") / _c("n")).alias("ps"), F.max_by("rev", "yr").alias("rev"))
    return t.select("code", F.round(_c("ps") * _c("rev") / 1000000, 4).alias("value"))


@query(f"WITH {SNAPSHOT} SELECT code, round(0.09::DOUBLE - balance / nullif(total_mv, 0), 8) AS implied_growth, round(1 / nullif(pe, 0), 8) AS earnings_yield FROM snap")
def v_reverse(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).select("code", F.round(0.09 - F.try_divide(_c("balance"), _c("total_mv")), 8).alias("implied_growth"), F.round(F.try_divide(F.lit(1.0), _c("pe")), 8).alias("earnings_yield"))


@query(f"""WITH {SNAPSHOT}, m AS (SELECT code, unnest([{{'v': pe, 'w': 0.5::DOUBLE}}, {{'v': pb * 2, 'w': 0.3::DOUBLE}}, {{'v': total_mv / 100000, 'w': 0.2::DOUBLE}}]) AS m FROM snap),
    a AS (SELECT code, sum(m.v * m.w) / sum(m.w) AS value, CASE WHEN count(*) > 1 THEN stddev_samp(m.v) / avg(m.v) * 100 END AS cv FROM m WHERE m.v > 0 GROUP BY 1)
    SELECT code, round(value, 9) AS value, CASE WHEN cv IS NULL THEN 'single' WHEN cv < 15 THEN 'high' WHEN cv < 30 THEN 'medium' ELSE 'low' END AS agreement FROM a""")
def v_cross(spark, sf_dir):
    out = fm.blended({"a": (_c("pe"), 0.5), "b": (_c("pb") * 2, 0.3), "c": (_c("total_mv") / 100000, 0.2)})
    return customer_snapshot(spark, sf_dir).select("code", F.round(out["value"], 9).alias("value"), out["agreement"].alias("agreement")).where("value is not null")


@query(f"WITH {_YEAR} SELECT code, CASE WHEN avg(rev) > 300000 AND stddev_samp(rev) / avg(rev) < 0.4::DOUBLE THEN 'blue' WHEN {_GROW} > 0.1::DOUBLE THEN 'growth' ELSE 'mixed' END AS kind FROM ann GROUP BY 1")
def v_classify(spark, sf_dir):
    g = F.pow(F.try_divide(F.max_by("rev", "yr"), F.min_by("rev", "yr")), F.try_divide(F.lit(1.0), F.count("*") - 1)) - 1
    kind = F.when((F.avg("rev") > 300000) & (F.try_divide(F.stddev_samp("rev"), F.avg("rev")) < 0.4), "blue").when(g > 0.1, "growth").otherwise("mixed")
    return _years(spark, sf_dir).groupBy("code").agg(kind.alias("kind"))


_TTM = f"""WITH {_YEAR}, cum AS (SELECT code, yr, q, sum(rev) OVER (PARTITION BY code, yr ORDER BY q) AS v FROM fin),
    l AS (SELECT * FROM cum QUALIFY row_number() OVER (PARTITION BY code ORDER BY yr DESC, q DESC) = 1)
    SELECT l.code, round(CASE WHEN l.q = 4 THEN l.v ELSE a.v + l.v - s.v END, 2) AS ttm FROM l LEFT JOIN cum s ON s.code = l.code AND s.yr = l.yr - 1 AND s.q = l.q LEFT JOIN cum a ON a.code = l.code AND a.yr = l.yr - 1 AND a.q = 4"""


@query(_TTM)
def f_ttm_a(spark, sf_dir):
    w = Window.partitionBy("code", "yr").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    cum = _quarters(spark, sf_dir).withColumn("v", F.sum("rev").over(w)).select("code", "yr", "q", "v")
    return fm.ttm(cum, "code", "yr", "q", "v").select("code", F.round("ttm", 2).alias("ttm"))


@query(f"WITH {SNAPSHOT} SELECT code, least(5 + CASE WHEN pe > 15 THEN 1.5 WHEN pe > 10 THEN 1.0 WHEN pe > 5 THEN 0.5 ELSE 0 END + CASE WHEN pb > 20 THEN 1.0 WHEN pb > 10 THEN 0.5 ELSE 0 END, 10)::DOUBLE AS s FROM snap")
def f_score_fund(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).select("code", fm.score_fundamental(_c("pe"), _c("pb")).alias("s"))


@query(f"WITH {SNAPSHOT} SELECT code, least(greatest(5 + CASE WHEN pe < 15 THEN 2 WHEN pe < 25 THEN 1 WHEN pe > 50 THEN -1 ELSE 0 END + CASE WHEN pb < 1.5 THEN 1 WHEN pb < 3 THEN 0.5 WHEN pb > 5 THEN -0.5 ELSE 0 END, 1), 10)::DOUBLE AS s FROM snap")
def f_score_val(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).select("code", fm.score_valuation(_c("pe"), _c("pb")).alias("s"))


@query(f"WITH {SNAPSHOT} SELECT code, CASE WHEN pb * 10 > 70 THEN 'high' WHEN pb * 10 > 50 THEN 'medium' ELSE 'low' END AS risk FROM snap")
def f_risk(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).select("code", fm.risk_band(_c("pb") * 10).alias("risk"))


@query(f"WITH {SNAPSHOT} SELECT code, coalesce(pe BETWEEN -100 AND 1000, true) AND coalesce(pb BETWEEN 0.1 AND 100, true) AS ok, CASE WHEN coalesce(pb BETWEEN 0.1 AND 100, true) THEN pb ELSE 1 END AS pb FROM snap")
def m_pe_valid(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).select("code", fm.pe_valid(_c("pe"), _c("pb")).alias("ok"), F.when(F.coalesce(_c("pb").between(0.1, 100), F.lit(True)), _c("pb")).otherwise(1.0).alias("pb"))


@query(f"WITH {SNAPSHOT} SELECT code, round((balance * (total_mv / 1000)) / nullif(total_mv / nullif(pe, 0), 0), 6) AS pe FROM snap")
def m_realtime_pe(spark, sf_dir):
    return customer_snapshot(spark, sf_dir).select("code", F.round(fm.realtime_pe(_c("balance"), F.lit(1000.0), _c("total_mv"), _c("pe")), 6).alias("pe"))


@query(f"WITH {SNAPSHOT}, w AS (SELECT code, unnest(list_filter([CASE WHEN pb > 8 THEN 'goodwill' END, CASE WHEN pe > 20 THEN 'debt' END, CASE WHEN total_mv IS NULL THEN 'missing' END], lambda x: x IS NOT NULL)) AS warning FROM snap) SELECT code, warning FROM w")
def m_warn(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir)
    return t.select("code", F.explode(fm.warnings({"goodwill": _c("pb") > 8, "debt": _c("pe") > 20, "missing": _c("total_mv").isNull()})).alias("warning"))


@query(f"WITH {SNAPSHOT}, g AS (SELECT unnest(range(7, 19)) AS i) SELECT code, i / 10.0::DOUBLE AS g, round(balance + pb * (1 - i / 10.0::DOUBLE), 6) AS oe FROM snap, g")
def m_ggrid(spark, sf_dir):
    t = customer_snapshot(spark, sf_dir).select("code", F.explode(fm.oe_band(_c("balance"), _c("pb"))).alias("x"))
    return t.select("code", _c("x.g").alias("g"), F.round("x.oe", 6).alias("oe"))


@query(f"WITH {_YEAR}, d AS (SELECT code, yr, rev, rev - lag(rev) OVER (PARTITION BY code ORDER BY yr) AS dr FROM ann), l AS (SELECT code, median(dr / nullif(rev, 0)) AS lam, arg_max(rev, yr) AS s FROM d GROUP BY 1), k AS (SELECT unnest([1.0::DOUBLE, 0.9::DOUBLE, 0.81::DOUBLE, 0.729::DOUBLE]) AS k) SELECT code, k, round(1000 + lam * (k - 1) * s, 6) AS surplus FROM l, k")
def m_revsens(spark, sf_dir):
    w = Window.partitionBy("code").orderBy("yr")
    t = _years(spark, sf_dir).withColumn("dr", _c("rev") - F.lag("rev").over(w))
    t = t.groupBy("code").agg(F.median(F.try_divide(_c("dr"), _c("rev"))).alias("lam"), F.max_by("rev", "yr").alias("s"))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), fm.surplus_at(F.lit(1000.0), _c("lam"), _c("s"), k).alias("surplus")) for k in (1.0, 0.9, 0.81, 0.729)])
    return t.select("code", F.explode(cells).alias("x")).select("code", "x.k", F.round("x.surplus", 6).alias("surplus"))


@query(f"WITH {_YEAR}, a AS (SELECT code, yr, rev, rev - lag(rev) OVER (PARTITION BY code ORDER BY yr) AS d, lag(yr) OVER (PARTITION BY code ORDER BY yr) AS y0 FROM ann) SELECT code, yr, rev - CASE WHEN y0 = yr - 1 THEN greatest(0, d) ELSE 0 END AS cash FROM a")
def m_cashrev(spark, sf_dir):
    y = _years(spark, sf_dir)
    before = y.select("code", (_c("yr") + 1).alias("yr"), _c("rev").alias("r0"))
    t = y.join(before, ["code", "yr"], "left")
    return t.select("code", "yr", (_c("rev") - F.coalesce(F.when(_c("r0").isNotNull(), F.greatest(F.lit(0.0), _c("rev") - _c("r0"))), F.lit(0.0))).alias("cash"))


@query("SELECT o_custkey AS code, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def f_audit3(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select(_c("o_custkey").alias("code"), "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, round(1 - l_tax / nullif(l_discount, 0), 7) AS margin FROM lineitem WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem)")
def f_segments(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    newest = t.agg(F.max("l_shipdate").alias("m"))
    return t.join(F.broadcast(newest), _c("l_shipdate") == _c("m")).select("l_orderkey", "l_linenumber", F.round(1 - F.try_divide(_c("l_tax"), _c("l_discount")), 7).alias("margin"))  # one row


@query("""WITH r AS (SELECT o_custkey AS code, o_orderdate AS d, round(o_totalprice, -4) AS hi, o_totalprice AS a, o_orderstatus AS s, o_orderkey AS k FROM orders),
    done AS (SELECT * FROM r WHERE s = 'F' QUALIFY row_number() OVER (PARTITION BY code, hi ORDER BY d DESC, k DESC) = 1),
    open AS (SELECT * FROM r WHERE s = 'O' QUALIFY row_number() OVER (PARTITION BY code, hi ORDER BY a DESC, k) = 1)
    SELECT code, count(*) AS n, round(sum(a), 2) AS total FROM (SELECT code, a FROM done UNION ALL SELECT o.code, o.a FROM open o WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.code = o.code AND d.hi = o.hi)) GROUP BY 1""")
def f_repurchase(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(_c("o_custkey").alias("code"), _c("o_orderdate").alias("d"), F.round("o_totalprice", -4).alias("hi"), _c("o_totalprice").alias("a"), _c("o_orderstatus").alias("s"), _c("o_orderkey").alias("k"))
    best = lambda x, *order: x.withColumn("r", F.row_number().over(Window.partitionBy("code", "hi").orderBy(*order))).where("r = 1").select("code", "hi", "a")
    done = best(t.where("s = 'F'"), F.desc("d"), F.desc("k"))
    left = best(t.where("s = 'O'"), F.desc("a"), "k").join(done.select("code", "hi"), ["code", "hi"], "left_anti")
    return done.unionByName(left).groupBy("code").agg(F.count("*").alias("n"), F.round(F.sum("a"), 2).alias("total"))


# --- texts -----------------------------------------------------------------------------------------------------------

_HIT = lambda x, words: "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"
_T, _B = "substr(text, 1, 120)", "substr(text, 121)"
_P = lambda w, a, b: f"CASE WHEN {_HIT(_T, w)} THEN {a} WHEN {_HIT(_B, w)} THEN {b} ELSE 0 END"
_SCORE = f"least(greatest({_P(['tion'], 50, 25)} + {_P(['ing'], 40, 20)} + {_P(['the', 'der'], 30, 15)} + {_P(['and'], 15, 8)} + {_P(['copyright', 'lorem'], -40, -20)} + CASE WHEN {_HIT(_T, ['copyright', 'lorem'])} AND NOT {_HIT(_T, ['tion'])} THEN -30 ELSE 0 END, 0), 100)"


def _scored(spark, sf_dir):
    t = table(spark, sf_dir, "documents")
    s = tx.relevance(F.substring("text", 1, 120), F.expr("substring(text, 121)"), "tion", "ing", ["the", "der"], ["and"], ["copyright", "lorem"])
    return t.select("doc_id", "lang", s.alias("score"))


@query(f"SELECT doc_id, {_SCORE} AS score FROM documents")
def nlp_relevance(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "score")


@query(f"SELECT doc_id, {_SCORE} AS score FROM documents WHERE {_SCORE} >= 30")
def nlp_filter(spark, sf_dir):
    return _scored(spark, sf_dir).where("score >= 30").select("doc_id", "score").orderBy(F.desc("score"), "doc_id")


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (s >= 30) AS kept, round(avg(s), 6) AS mean, max(s) AS hi, min(s) AS lo FROM (SELECT lang, {_SCORE} AS s FROM documents) GROUP BY 1")
def nlp_filter_stats(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(_c("score") >= 30).alias("kept"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("hi"), F.min("score").alias("lo"))


@query(f"SELECT doc_id, CASE WHEN {_HIT('text', ['licensed', 'rights'])} THEN 'high' WHEN {_HIT('text', ['tion'])} THEN 'medium' ELSE 'low' END AS urgency FROM documents")
def nlp_urgency(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.urgency(_c("text"), ["licensed", "rights"], ["tion"]).alias("urgency"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'a1') THEN 1.0 WHEN contains(lower(p_name), 'green') OR contains(lower(p_name), 'blue') THEN 0.8 WHEN contains(p_name, '1') THEN 0.9 ELSE 0.3 END::DOUBLE AS rel FROM part")
def nlp_title_rel(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.title_relevance(_c("p_name"), "A1", ["green", "blue"]).alias("rel"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(substr(text, 1, 60), ' ')) ORDER BY doc_id) AS r FROM documents WHERE length(lower(trim(substr(text, 1, 60), ' '))) > 10) WHERE r = 1 ORDER BY doc_id DESC LIMIT 100")
def nlp_dedup(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"))
    return tx.dedup_titles(t, "title", [F.asc("doc_id")], [F.desc("doc_id")], 100).select("doc_id")


@query("SELECT doc_id, s FROM (SELECT doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')), ['the', 'von', 'que', 'licensed'])) AS s FROM documents) WHERE s > 0")
def nlp_fulltext(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tx.full_text(_c("text"), ["the", "von", "que", "licensed"]).alias("s"))
    return t.where("s > 0")


_ONE = lambda w: f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END"
_G, _BAD = f"({_ONE('the')} + {_ONE('und')})", f"({_ONE('loser')} + {_ONE('trash')} + {_ONE('que')})"
_SENT = f"coalesce(({_G} - {_BAD})::DOUBLE / nullif({_G} + {_BAD}, 0), 0)"


@query(f"SELECT doc_id, round({_SENT}, 7) AS s, CASE WHEN {_SENT} > 0.3 THEN 'very_positive' WHEN {_SENT} > 0.1 THEN 'positive' WHEN {_SENT} < -0.3 THEN 'very_negative' WHEN {_SENT} < -0.1 THEN 'negative' ELSE 'neutral' END AS band FROM documents")
def nlp_lex_sentiment(spark, sf_dir):
    s = tx.lexicon_sentiment(_c("text"), ["the", "und"], ["loser", "trash", "que"])
    return table(spark, sf_dir, "documents").select("doc_id", F.round(s, 7).alias("s"), tx.band(s).alias("band"))


@query(f"SELECT source, round((count(*) FILTER ({_SENT} > 0.1) - count(*) FILTER ({_SENT} < -0.1))::DOUBLE / count(*), 7) AS s FROM documents GROUP BY 1")
def nlp_news_sentiment(spark, sf_dir):
    s = tx.lexicon_sentiment(_c("text"), ["the", "und"], ["loser", "trash", "que"])
    t = table(spark, sf_dir, "documents").select("source", s.alias("s"))
    return t.groupBy("source").agg(F.round((F.count_if(_c("s") > 0.1) - F.count_if(_c("s") < -0.1)) / F.count("*"), 7).alias("s"))


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - list_sum(list_transform(list_zip(embedding, e), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 10")
def nlp_memory(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    row = t.where("vec_id = 0").select("embedding").first()
    return tx.nearest(t, list(row[0]), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))
