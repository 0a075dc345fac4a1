"""Queries of surplus, payout reconciliation and the grid of penetrating returns, on yearly statements derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import surplus as sp
from quantloom.sources.bars import table

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


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's years: money in whole units, so that sums don't depend on their order. Dividends per share of every third company are in another currency, of every fourth one figure."""
    t = table(spark, sf_dir, "orders").select(_c("o_custkey").alias("code"), F.year("o_orderdate").alias("yr"), F.round("o_totalprice").cast("long").alias("v"), _c("o_orderstatus").alias("s"), _c("o_orderpriority").alias("p"))
    of = lambda cond: F.sum(F.when(cond, _c("v")))
    t = t.groupBy("code", "yr").agg(
        F.sum("v").alias("revenue"), of(_c("s") != "P").alias("tcr"), of(_c("p") < "4").alias("w"), of(_c("p") == "5-LOW").alias("capex"), of(_c("s") == "O").alias("paid"), of(_c("s") == "F").alias("held")
    )
    dps = F.when(_c("code") % 4 == 0, 0.5).otherwise(_c("held") / 1e6)
    return t.select(
        "code", "yr", _c("revenue").cast("double").alias("revenue"), _c("tcr").cast("double").alias("tcr"), (_c("w") / 2).alias("w"), (_c("capex") / 4).alias("capex"),
        (_c("revenue") / 8).alias("profit"), ((_c("revenue") - 90000) / 4e5).alias("eps"), (_c("paid") / 16).alias("dist"), (_c("held") / _c("revenue") * 60).alias("payout"),
        F.when(_c("code") % 3 != 0, F.when(_c("held").isNotNull(), dps)).alias("dps"), F.when(_c("code") % 3 == 0, _c("held") / 1e6).alias("dps_hkd"),
    )


STATEMENTS = """sv AS (SELECT o_custkey AS code, year(o_orderdate) AS yr, sum(v) AS revenue, sum(v) FILTER (o_orderstatus <> 'P') AS tcr, sum(v) FILTER (o_orderpriority < '4') AS w,
        sum(v) FILTER (o_orderpriority = '5-LOW') AS capex, sum(v) FILTER (o_orderstatus = 'O') AS paid, sum(v) FILTER (o_orderstatus = 'F') AS held
    FROM (SELECT *, round(o_totalprice)::BIGINT AS v FROM orders) GROUP BY 1, 2),
st AS (SELECT code, yr, revenue::DOUBLE AS revenue, tcr::DOUBLE AS tcr, w / 2 AS w, capex / 4 AS capex, revenue / 8 AS profit, (revenue - 90000) / 4e5::DOUBLE AS eps, paid / 16 AS dist,
        held / revenue * 60 AS payout, CASE WHEN code % 3 <> 0 AND held IS NOT NULL THEN CASE WHEN code % 4 = 0 THEN 0.5 ELSE held / 1e6::DOUBLE END END::DOUBLE AS dps,
        CASE WHEN code % 3 = 0 THEN held / 1e6::DOUBLE END AS dps_hkd FROM sv)"""

SURPLUS = """sb AS (SELECT code, yr, tcr - w - coalesce(capex, 0) AS base, coalesce(revenue, 0) AS rev FROM st WHERE tcr IS NOT NULL AND w IS NOT NULL),
sl AS (SELECT *, base - lag(base) OVER o AS db, rev - lag(rev) OVER o AS dr, row_number() OVER (PARTITION BY code ORDER BY yr DESC) AS k FROM sb WINDOW o AS (PARTITION BY code ORDER BY yr)),
sr AS (SELECT code, db / dr AS ratio FROM sl WHERE dr <> 0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY yr DESC) <= 3),
sm AS (SELECT code, median(ratio) AS lam, bool_or(ratio >= 0) AND bool_or(ratio < 0) AS mixed FROM sr GROUP BY 1),
sc AS (SELECT code, count(*) FILTER (revenue > 0) AS n, stddev_pop(revenue) FILTER (revenue > 0) / avg(revenue) FILTER (revenue > 0) AS cv FROM st GROUP BY 1),
sa AS (SELECT code, count(*) AS years, avg(base) AS aa_all, avg(base) FILTER (k <= 2) AS aa_2y, coalesce(avg(base) FILTER (base >= 0), avg(base)) AS aa_excl,
        max(rev) FILTER (rev > 0) / min(rev) FILTER (rev > 0) - 1 AS span FROM sl GROUP BY 1),
sx AS (SELECT sa.*, CASE WHEN years >= 2 THEN aa_2y ELSE aa_all END AS aa, CASE WHEN n >= 2 THEN cv END AS cv, lam, coalesce(n >= 3 AND span < 0.1, false) AS low_amplitude,
        coalesce(mixed, false) AS mixed_signs, coalesce(lam > 3 OR lam < 0, false) AS odd_lambda FROM sa JOIN sc USING (code) LEFT JOIN sm USING (code)),
surplus AS (SELECT *, CASE WHEN odd_lambda OR low_amplitude::INT + mixed_signs::INT >= 2 THEN 'several' WHEN low_amplitude OR mixed_signs THEN 'one' ELSE 'normal' END AS reliability FROM sx)"""

PAYOUT = """pl AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY yr DESC) AS k, count(dps) OVER (PARTITION BY code) > 0 AS home FROM st),
pm AS (SELECT code, avg(CASE WHEN eps > 0 THEN CASE WHEN home THEN dps WHEN dps_hkd <> 0 THEN dps_hkd END / eps * 100 END) FILTER (k <= 3) AS m1,
        avg(CASE WHEN profit > 0 THEN dist / profit * 100 END) FILTER (k <= 3) AS m2, avg(payout) FILTER (k <= 3) AS m3,
        bool_or(home) AND count(dps) >= 3 AND count(DISTINCT round(dps, 6)) = 1 AS same, NOT bool_or(home) AND bool_or(coalesce(dps_hkd <> 0, false)) AS currency_note FROM pl GROUP BY 1),
pd AS (SELECT *, list_transform([{'p': 'm1/m2', 'a': m1, 'b': m2}, {'p': 'm1/m3', 'a': m1, 'b': m3}, {'p': 'm2/m3', 'a': m2, 'b': m3}],
        lambda x: {'p': x.p, 'd': coalesce(abs(x.a - x.b) / nullif((abs(x.a) + abs(x.b)) / 2, 0), 0)}) AS ds FROM pm),
px AS (SELECT *, list_max(list_transform(ds, lambda x: x.d)) AS max_dev FROM pd),
py AS (SELECT *, CASE WHEN max_dev > 0 THEN list_filter(ds, lambda x: x.d = max_dev)[1].p END AS pair, CASE WHEN max_dev > 0.15 AND m2 IS NOT NULL THEN 'apart' WHEN same AND m2 IS NOT NULL THEN 'filled_in'
        WHEN m3 IS NOT NULL THEN 'agree' WHEN m2 IS NOT NULL THEN 'no_series' WHEN m1 IS NOT NULL THEN 'only_first' END AS rule FROM px),
payout AS (SELECT *, CASE WHEN rule = 'agree' THEN 'm3' WHEN rule = 'only_first' THEN 'm1' ELSE 'm2' END AS label, CASE WHEN rule = 'agree' THEN m3 WHEN rule = 'only_first' THEN m1 ELSE m2 END AS m FROM py WHERE rule IS NOT NULL)"""


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else _c(c) for c, t in df.dtypes])


@query(f"""WITH {STATEMENTS}, {SURPLUS} SELECT code, years, round(aa_all, 4) AS aa_all, round(aa_2y, 4) AS aa_2y, round(aa_excl, 4) AS aa_excl, round(aa, 4) AS aa, round(cv, 4) AS cv,
    round(lam, 4) AS lambda, low_amplitude, mixed_signs, odd_lambda, reliability FROM surplus""")
def m_surplus(spark, sf_dir):
    return _rounded(sp.surplus(statements(spark, sf_dir)), 4)


@query(f"WITH {STATEMENTS}, {PAYOUT} SELECT code, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3, round(max_dev, 6) AS max_dev, pair, same AS identical_dps, currency_note, rule, label, round(m, 6) AS m FROM payout")
def m_payout_x(spark, sf_dir):
    return _rounded(sp.payout_crosscheck(statements(spark, sf_dir)))


@query(f"""WITH RECURSIVE {STATEMENTS}, {SURPLUS}, {PAYOUT},
    g AS (SELECT code, label, m1, m2, m3, aa_2y, aa_all, aa_excl, c, c * 19.37::DOUBLE AS cap, c / 1000 AS close, 3.0::DOUBLE + code % 5 AS ii FROM payout JOIN surplus USING (code)
        JOIN (SELECT code, arg_max(profit, yr) AS c FROM st GROUP BY 1) USING (code)),
    cand AS (SELECT code, kind, name, v, row_number() OVER (PARTITION BY code, kind ORDER BY name <> label, ord) AS i, tol FROM (
        SELECT code, label, 'm' AS kind, unnest(['m1', 'm2', 'm3']) AS name, unnest([m1, m2, m3]) AS v, unnest([1, 2, 3]) AS ord, 0.5::DOUBLE AS tol FROM g
        UNION ALL SELECT code, '', 'a', unnest(['aa_2y', 'aa_all', 'aa_excl']), unnest([aa_2y, aa_all, aa_excl]), unnest([1, 2, 3]), 10000.0::DOUBLE FROM g)),
    walk AS (SELECT code, kind, 0::BIGINT AS i, [] ::STRUCT(name VARCHAR, v DOUBLE)[] AS kept FROM cand WHERE i = 1
        UNION ALL SELECT w.code, w.kind, c.i, CASE WHEN c.v IS NULL OR len(list_filter(w.kept, lambda k: abs(c.v - k.v) < c.tol)) > 0 THEN w.kept ELSE list_append(w.kept, {{'name': c.name, 'v': c.v}}) END
        FROM walk w JOIN cand c ON c.code = w.code AND c.kind = w.kind AND c.i = w.i + 1),
    kept AS (SELECT code, kind, unnest(kept) AS k FROM walk WHERE i = 3),
    x AS (SELECT g.*, a.k.name AS base, a.k.v AS av, m.k.name AS ratio, m.k.v AS m, q FROM g JOIN kept a ON a.code = g.code AND a.kind = 'a' JOIN kept m ON m.code = g.code AND m.kind = 'm', (VALUES (0.0::DOUBLE), (10.0::DOUBLE), (20.0::DOUBLE)) t(q)),
    y AS (SELECT *, c * m / 100 * (1 - q / 100) / cap * 100 AS r, av * m / 100 * (1 - q / 100) / cap * 100 AS gg, av * m / 100 * (1 - 10.0::DOUBLE / 100) / cap * 100 AS g10 FROM x)
    SELECT code, base, ratio, q, round(m, 7) AS m, round(r, 7) AS r, round(gg, 7) AS gg, round(r - gg, 7) AS hh, round(gg - ii, 7) AS excess, round(close * g10 / ii, 7) AS target, ratio = label AS recommended FROM y""")
def m_grid(spark, sf_dir):
    """Payout ratios and bases that lie too near one kept before are taken out in order."""
    st = statements(spark, sf_dir)
    latest = st.groupBy("code").agg(F.max_by("profit", "yr").alias("c"))
    t = sp.payout_crosscheck(st).join(sp.surplus(st), "code").join(latest, "code")
    t = t.withColumns({"cap": _c("c") * 19.37, "close": _c("c") / 1000, "ii": 3.0 + _c("code") % 5})
    return _rounded(sp.penetration_grid(t, [0.0, 10.0, 20.0], 10.0), 7)
