"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ["q_panel", "q_factors", "q_indicators", "q_relational", "q_scalar", "q_models", "q_machines", "q_derived", "q_screener", "q_records", "q_sinks", "q_surplus", "q_valuation", "q_reports"]
FLAGSHIP = "join_screen_view"

def _dated(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Dates as text (yyyy-MM-dd), which every reader of results shows alike."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if t == "date" else F.col(f"`{c}`") for c, t in df.dtypes])

    return run


def _dated_sql(sql: str, columns: list[str]) -> str:
    if not columns:
        return sql
    return "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns) + f") FROM ({sql})"


#: The date columns of queries: those of every panel, and others by query.
PANEL = ["trade_date"]
OTHERS = {
    "src_trade_cal": ["cal_date"], "join_source_compare": ["day"], "agg_usage": ["day"], "agg_usage_daily": ["day"], "agg_completeness": ["newest"],
    "agg_resample_week": ["week"], "win_drawdown_loc": ["trough"], "win_gap": ["d", "nxt"],
}
PANELS = set(
    "src_hist src_normalize src_chip_klines flt_tree flt_cross_up flt_cross_down prj_std_record join_panel_align "
    "top_sample_step bt_signals bt_signals_momentum mom_hedge".split()
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _m = import_module(f"{__package__}.{_name}")
    if _twice := QUERIES.keys() & _m.QUERIES.keys():
        raise ValueError(f"registered twice: {sorted(_twice)}")
    QUERIES |= {k: _dated(q) for k, q in _m.QUERIES.items()}
    _panel = _name in ("q_panel", "q_factors", "q_indicators")
    ORACLES |= {k: _dated_sql(v, OTHERS.get(k, PANEL if _panel or k in PANELS else [])) for k, v in _m.ORACLES.items()}
