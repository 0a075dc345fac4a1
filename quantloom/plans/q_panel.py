"""Queries of the panel operators on weekly bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.operators import panel as p
from quantloom.sources.bars import BARS, weekly_brand_bars

S = "PARTITION BY symbol ORDER BY trade_date"
D = "PARTITION BY trade_date"


def n_rows(n: int) -> str:
    return f"({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full_sql(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {n_rows(n)} = {n} THEN {value} END"


def windowed(name: str, x: str, n: int) -> str:
    return full_sql(x, n, f"{name}({x}) OVER {n_rows(n)}")


def one(value: Callable[[Column, Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """A query for one operator. Columns need a session, so ``value`` makes them when the query runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = value(F.col("close"), F.col("volume"))
        return weekly_brand_bars(spark, sf_dir).select("symbol", "trade_date", F.round(x.cast("double"), 7).alias("value"))

    return run


def one_sql(value: str) -> str:
    return f"WITH {BARS} SELECT symbol, trade_date, round(({value})::DOUBLE, 7) AS value FROM bars"


_closes = f"list(close) OVER {n_rows(20)}"

SPECS: dict[str, tuple[Callable[[Column, Column], Column], str]] = {
    "cs_rank": (lambda c, v: p.cs_rank(c), f"(rank() OVER ({D} ORDER BY close) + (count(*) OVER (PARTITION BY trade_date, close) - 1) / 2.0::DOUBLE) / count(close) OVER ({D})"),
    "cs_zscore": (lambda c, v: p.cs_zscore(c), f"CASE WHEN stddev_samp(close) OVER ({D}) > 0 THEN (close - avg(close) OVER ({D})) / stddev_samp(close) OVER ({D}) END"),
    "cs_scale": (lambda c, v: p.cs_scale(c), f"close / sqrt(sum(close * close) OVER ({D}))"),
    "ts_rank": (lambda c, v: p.ts_rank(c, 20), full_sql("close", 20, f"(len(list_filter({_closes}, lambda q: q < close)) + 0.5::DOUBLE * (len(list_filter({_closes}, lambda q: q = close)) + 1)) / 20")),
    "ts_mean": (lambda c, v: w.mean(c, 20), windowed("avg", "close", 20)),
    "ts_sum": (lambda c, v: w.total(c, 20), windowed("sum", "close", 20)),
    "ts_std": (lambda c, v: w.std(c, 20), windowed("stddev_samp", "close", 20)),
    "ts_max": (lambda c, v: w.highest(c, 20), windowed("max", "close", 20)),
    "ts_min": (lambda c, v: w.lowest(c, 20), windowed("min", "close", 20)),
    "ts_argmax": (lambda c, v: p.ts_argmax(c, 5), full_sql("close", 5, f"list_position(list(close) OVER {n_rows(5)}, max(close) OVER {n_rows(5)}) - 1")),
    "ts_argmin": (lambda c, v: p.ts_argmin(c, 5), full_sql("close", 5, f"list_position(list(close) OVER {n_rows(5)}, min(close) OVER {n_rows(5)}) - 1")),
    "ts_delay": (lambda c, v: w.lag(c, 5), f"lag(close, 5) OVER ({S})"),
    "delta": (lambda c, v: c - w.lag(c, 5), f"close - lag(close, 5) OVER ({S})"),
    "decay_linear": (lambda c, v: p.decay_linear(c, 5), "(close" + "".join(f" + {k + 1} * lag(close, {k}) OVER ({S})" for k in range(1, 5)) + ") / 15"),
    "signed_power": (lambda c, v: p.signed_power(F.try_divide(c, w.lag(c, 1)) - 1, 2.0), f"sign(close / lag(close) OVER ({S}) - 1) * pow(abs(close / lag(close) OVER ({S}) - 1), 2)"),
    "safe_div": (lambda c, v: w.safe_div(c, v - 150), "close / nullif((volume - 150) + 1e-12::DOUBLE * sign(volume - 150), 0)"),
    "ts_corr": (lambda c, v: p.ts_corr(c, v, 20), full_sql("close", 20, f"covar_samp(close, volume) OVER {n_rows(20)} / nullif(stddev_samp(close) OVER {n_rows(20)} * stddev_samp(volume) OVER {n_rows(20)}, 0)")),
    "ts_cov": (lambda c, v: p.ts_cov(c, v, 20), full_sql("close", 20, f"covar_samp(close, volume) OVER {n_rows(20)}")),
    "vwap": (lambda c, v: p.vwap(), "amount * 1000 / (volume * 100 + 1)"),
    "win_prev_close": (lambda c, v: w.lag(c, 1), f"lag(close) OVER ({S})"),
    "win_pct_change": (lambda c, v: F.try_divide(c - w.lag(c, 1), w.lag(c, 1)) * 100, f"(close - lag(close) OVER ({S})) / nullif(lag(close) OVER ({S}), 0) * 100"),
    "win_drawdown": (lambda c, v: F.try_divide(c, F.max(c).over(w.so_far())) - 1, f"close / max(close) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1"),
    "fn_js_round": (lambda c, v: w.js_round(c - 1500, 1), "floor((close - 1500) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"),
}


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse panel (weeks in which a brand sold over 100 units) made dense, then a mean over calendar rows."""
    sparse = weekly_brand_bars(spark, sf_dir).where("volume > 100").select("symbol", "trade_date", "close")
    dense = p.densify(sparse)
    mean = F.avg("close").over(w.last(4))
    return dense.select("symbol", "trade_date", F.round(mean, 7).alias("value"))


GAPS = f"""
    WITH {BARS}, sparse AS (SELECT symbol, trade_date, close FROM bars WHERE volume > 100)
    SELECT symbol, trade_date, round(avg(close) OVER {n_rows(4)}, 7) AS value
    FROM (SELECT DISTINCT symbol FROM sparse) CROSS JOIN (SELECT DISTINCT trade_date FROM sparse) LEFT JOIN sparse USING (symbol, trade_date)
"""

QUERIES = {**{k: one(f) for k, (f, _) in SPECS.items()}, "densify": gaps}
ORACLES = {**{k: one_sql(sql) for k, (_, sql) in SPECS.items()}, "densify": GAPS}
