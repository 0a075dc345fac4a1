"""Queries of the 30 factors on weekly bars, with made fundamentals beside the prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import factors
from quantloom.sources.bars import BARS, weekly_brand_bars

from .q_panel import D, S, full_sql, n_rows, windowed


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars with ``roe, pe_ttm, pb, profit_yoy, dv_ttm`` made from them."""
    bars = weekly_brand_bars(spark, sf_dir)
    c, v = F.col("close"), F.col("volume")
    return bars.withColumns({"roe": c / v, "pe_ttm": c - 1400, "pb": c / 700, "profit_yoy": v - 150, "dv_ttm": v / 50})


FUND = f"""{BARS}, fund AS (
    SELECT *, close / volume AS roe, close - 1400 AS pe_ttm, close / 700 AS pb, volume - 150 AS profit_yoy, volume / 50 AS dv_ttm FROM bars),
 rets AS (SELECT *, close / lag(close) OVER ({S}) - 1 AS ret, close - lag(close) OVER ({S}) AS change, volume - lag(volume) OVER ({S}) AS vchange,
                 row_number() OVER ({S}) AS rn, lag(close) OVER ({S}) AS before FROM fund)"""


def _div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}) + 1e-12::DOUBLE * sign({b}), 0))"


def _rank(x: str, n: int) -> str:
    xs = f"list({x}) OVER {n_rows(n)}"
    return full_sql(x, n, f"(len(list_filter({xs}, lambda q: q < {x})) + 0.5::DOUBLE * (len(list_filter({xs}, lambda q: q = {x})) + 1)) / {n}")


#: name -> (extra common table expressions on ``rets``, table, value)
SQL: dict[str, tuple[str, str, str]] = {
    "MOM_20": ("", "rets", f"{_div('close', f'lag(close, 20) OVER ({S})')} - 1"),
    "ROC_10": ("", "rets", f"{_div('close', f'lag(close, 10) OVER ({S})')} - 1"),
    "ALPHA_001": (
        f", a AS (SELECT *, {windowed('stddev_samp', 'ret', 20)} AS sd FROM rets), b AS (SELECT *, CASE WHEN sd IS NOT NULL THEN pow(CASE WHEN ret < 0 THEN sd ELSE close END, 2) END AS sig FROM a), "
        f"c AS (SELECT *, {full_sql('sig', 5, f'list_position(list(sig) OVER {n_rows(5)}, max(sig) OVER {n_rows(5)}) - 1')} AS place FROM b)",
        "c", f"CASE WHEN place IS NOT NULL THEN (rank() OVER ({D} ORDER BY place NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, place) - 1) / 2.0::DOUBLE) / count(place) OVER ({D}) - 0.5::DOUBLE END"),
    "TS_RANK_20": ("", "rets", _rank("close", 20)),
    "MOM_ACCEL": (f", a AS (SELECT *, {_div('close', f'lag(close, 20) OVER ({S})')} - 1 AS mom FROM rets)", "a", f"mom - lag(mom, 5) OVER ({S})"),
    "MA_CROSS_20_60": (f", a AS (SELECT *, {windowed('avg', 'close', 20)} AS m1, {windowed('avg', 'close', 60)} AS m2 FROM rets)", "a", f"{_div('m1', 'm2')} - 1"),
    "MAX_20_RET": (f", a AS (SELECT *, {windowed('max', 'close', 20)} AS m FROM rets)", "a", f"{_div('close', 'm')} - 1"),
    "BIAS_20": (f", a AS (SELECT *, {windowed('avg', 'close', 20)} AS m FROM rets)", "a", f"{_div('close', 'm')} - 1"),
    "BOLL_DIST": (f", a AS (SELECT *, {windowed('avg', 'close', 20)} AS m, {windowed('stddev_samp', 'close', 20)} AS sd FROM rets)", "a", _div("close - m", "4 * sd")),
    "REV_TS_RANK_20": ("", "rets", f"0.5::DOUBLE - {_rank('close', 20)}"),
    "RSV_20": (f", a AS (SELECT *, {windowed('min', 'low', 20)} AS lo, {windowed('max', 'high', 20)} AS hi FROM rets)", "a", _div("close - lo", "hi - lo")),
    "PSY_20": (", a AS (SELECT *, CASE WHEN change > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up FROM rets)", "a", windowed("avg", "up", 20)),
    "VOL_20": ("", "rets", windowed("stddev_samp", "ret", 20)),
    "ATR_14": (", a AS (SELECT *, CASE WHEN before IS NOT NULL THEN greatest(high - low, abs(high - before), abs(low - before)) END AS tr FROM rets)", "a", _div(windowed("avg", "tr", 14), "close")),
    "VOL_CHG_5": (f", a AS (SELECT *, {windowed('stddev_samp', 'ret', 20)} AS sd FROM rets)", "a", f"sd - lag(sd, 5) OVER ({S})"),
    "VOL_RATIO": (f", a AS (SELECT *, {windowed('stddev_samp', 'ret', 5)} AS s5, {windowed('stddev_samp', 'ret', 20)} AS s20 FROM rets)", "a", _div("s5", "s20")),
    "RANGE_20": (f", a AS (SELECT *, {windowed('min', 'low', 20)} AS lo, {windowed('max', 'high', 20)} AS hi, {windowed('avg', 'close', 20)} AS m FROM rets)", "a", _div("hi - lo", "m")),
    "OBV_20": (f", a AS (SELECT *, sum(coalesce(sign(change), 0) * volume) OVER ({S}) AS obv, {windowed('avg', 'volume', 20)} AS m FROM rets)", "a", _div(f"obv - lag(obv, 20) OVER ({S})", "m")),
    "VR_20": (f", a AS (SELECT *, CASE WHEN change > 0 THEN volume ELSE 0 END AS up, CASE WHEN change < 0 THEN volume ELSE 0 END AS down FROM rets), b AS (SELECT *, {windowed('sum', 'up', 20)} AS u, {windowed('sum', 'down', 20)} AS d FROM a)", "b", _div("u", "d")),
    "VOL_RATIO_5": (f", a AS (SELECT *, {windowed('avg', 'volume', 5)} AS m FROM rets)", "a", _div("volume", "m")),
    "CORR_20": (", a AS (SELECT *, ln(1 + volume) AS lv FROM rets)", "a", full_sql("close", 20, f"covar_samp(close, lv) OVER {n_rows(20)} / nullif(stddev_samp(close) OVER {n_rows(20)} * stddev_samp(lv) OVER {n_rows(20)}, 0)")),
    "VMA_20": (f", a AS (SELECT *, {windowed('avg', 'volume', 20)} AS m FROM rets)", "a", _div("m", "volume")),
    "VSUMP_10": (f", a AS (SELECT *, CASE WHEN vchange IS NOT NULL THEN greatest(vchange, 0) END AS up, abs(vchange) AS av FROM rets), b AS (SELECT *, {windowed('sum', 'up', 10)} AS u, {windowed('sum', 'av', 10)} AS t FROM a)", "b", _div("u", "t")),
    "ROE_CHG_Q": ("", "rets", f"roe - lag(roe) OVER ({S})"),
    "PE_PCT_250": ("", "rets", _rank("pe_ttm", 250)),
    "EP_TTM": ("", "rets", "CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END"),
    "BP": ("", "rets", _div("1", "pb")),
    "PEG": ("", "rets", _div("pe_ttm", "profit_yoy")),
    "DV_TTM": ("", "rets", "dv_ttm"),
}

#: The exponentially weighted sums, one bar after the other.
RSI = f"""
    WITH RECURSIVE {FUND}, f AS (
        SELECT symbol, trade_date, rn, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l FROM rets WHERE rn = 1
        UNION ALL
        SELECT r.symbol, r.trade_date, r.rn, f.g * 13 / 14 + greatest(r.change, 0), f.l * 13 / 14 + greatest(-r.change, 0)
        FROM f JOIN rets r ON r.symbol = f.symbol AND r.rn = f.rn + 1)
    SELECT symbol, trade_date, round(CASE WHEN rn > 14 THEN 100 * g / nullif(g + l, 0) END, 7) AS value FROM f
"""


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = factors.compute_factor(fundamentals(spark, sf_dir), name)
        return out.select("symbol", "trade_date", F.round("value", 7).alias("value"))

    return run


def top_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last momentum of each symbol that isn't null, highest first, ten symbols."""
    t = factors.compute_factor(fundamentals(spark, sf_dir), "MOM_20").where("value is not null")
    last = t.groupBy("symbol").agg(F.max_by("value", "trade_date").alias("v"), F.max("trade_date").alias("trade_date"))
    return last.select("symbol", "trade_date", F.round("v", 7).alias("value")).orderBy(F.desc("value"), "symbol").limit(10)


def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["MOM_20", "VOL_20", "BIAS_20", "CORR_20"]
    t = factors.compute_factor_panel(fundamentals(spark, sf_dir), names)
    return t.select("symbol", "trade_date", *[F.round(n, 7).alias(n.lower()) for n in names])


QUERIES = {f"factor_{k.lower()}": _query(k) for k in [*SQL, "RSI_14"]} | {"top_factor": top_factor, "factor_panel": factor_panel}
ORACLES = {f"factor_{k.lower()}": f"WITH {FUND}{extra} SELECT symbol, trade_date, round(({value})::DOUBLE, 7) AS value FROM {at}" for k, (extra, at, value) in SQL.items()} | {
    "factor_rsi_14": RSI,
    "top_factor": f"WITH {FUND}, m AS (SELECT symbol, trade_date, {SQL['MOM_20'][2]} AS v FROM rets) SELECT symbol, max(trade_date) AS trade_date, round(arg_max(v, trade_date), 7) AS value FROM m WHERE v IS NOT NULL GROUP BY symbol ORDER BY value DESC, symbol LIMIT 10",
    "factor_panel": f"WITH {FUND} SELECT symbol, trade_date, round({SQL['MOM_20'][2]}, 7) AS mom_20, round({SQL['VOL_20'][2]}, 7) AS vol_20, round({_div('close', windowed('avg', 'close', 20))} - 1, 7) AS bias_20, "
    + "round(" + full_sql("close", 20, f"covar_samp(close, ln(1 + volume)) OVER {n_rows(20)} / nullif(stddev_samp(close) OVER {n_rows(20)} * stddev_samp(ln(1 + volume)) OVER {n_rows(20)}, 0)") + ", 7) AS corr_20 FROM rets",
}
