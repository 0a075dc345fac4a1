"""The quant measures for SQL text: scalar functions that Catalyst inlines, and table functions for what rows can't hold.

``register`` adds to a session:

* ``q_ann_return, q_ann_vol, q_sharpe, q_sortino, q_mdd, q_calmar, q_var, q_cvar`` over an array of returns or of equity
  (``collect_list`` of a group), ``q_moic, q_dpi`` over an array of flows: SQL functions, so a plan with them has no Python;
* ``quant(name, values, parameter => ...)``: any measure by name; unknown names and parameters fail when the query is analysed;
* ``chip_histogram(TABLE(bars), ...)``: the distribution of holding prices of each symbol, of which it keeps the last bars alone.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

R, P = "xs ARRAY<DOUBLE>", "periods DOUBLE DEFAULT 244"
_SUM = "aggregate({0}, 0D, (s, x) -> s + x)"
_MEAN = "try_divide(" + _SUM + ", size({0}))"

#: Name, parameters and body; later ones use earlier ones. Nulls in the array don't count.
SCALARS = [
    ("q_there", R, "filter(xs, x -> x IS NOT NULL)", "ARRAY<DOUBLE>"),
    ("q_mean", R, _MEAN.format("q_there(xs)"), "DOUBLE"),
    ("q_sd", R, "CASE WHEN size(q_there(xs)) > 1 THEN sqrt(" + _SUM.format("transform(q_there(xs), x -> (x - q_mean(xs)) * (x - q_mean(xs)))") + " / (size(q_there(xs)) - 1)) END", "DOUBLE"),
    ("q_growth", R, "aggregate(q_there(xs), 1D, (s, x) -> s * (1 + x))", "DOUBLE"),
    ("q_ann_return", f"{R}, {P}", "CASE WHEN q_growth(xs) > 0 THEN power(q_growth(xs), try_divide(periods, size(q_there(xs)))) - 1 END", "DOUBLE"),
    ("q_ann_vol", f"{R}, {P}", "q_sd(xs) * sqrt(periods)", "DOUBLE"),
    ("q_sharpe", f"{R}, rf DOUBLE DEFAULT 0, {P}", "CASE WHEN q_sd(xs) > 1e-12 * greatest(abs(q_mean(xs)), 1D) THEN (q_mean(xs) - rf / periods) / q_sd(xs) * sqrt(periods) END", "DOUBLE"),
    ("q_downside", f"{R}, target DOUBLE DEFAULT 0", "sqrt(q_mean(transform(q_there(xs), x -> power(least(x - target, 0D), 2))))", "DOUBLE"),
    ("q_sortino", f"{R}, target DOUBLE DEFAULT 0, {P}", "CASE WHEN q_downside(xs, target) > 0 THEN (q_mean(xs) - target) / q_downside(xs, target) * sqrt(periods) END", "DOUBLE"),
    # The fold carries the highest equity and the deepest fall below it.
    ("q_mdd", R, "aggregate(q_there(xs), named_struct('top', CAST(NULL AS DOUBLE), 'mdd', CAST(NULL AS DOUBLE)), (s, x) -> named_struct('top', greatest(s.top, x), 'mdd', greatest(s.mdd, 1 - try_divide(x, greatest(s.top, x)))), s -> s.mdd)", "DOUBLE"),
    ("q_calmar", f"returns ARRAY<DOUBLE>, equity ARRAY<DOUBLE>, {P}", "try_divide(q_ann_return(returns, periods), CASE WHEN q_mdd(equity) > 0 THEN q_mdd(equity) END)", "DOUBLE"),
    ("q_worst", f"{R}, confidence DOUBLE DEFAULT 0.95", "slice(array_sort(q_there(xs)), 1, greatest(CAST(ceil((1 - confidence) * size(q_there(xs)) - 1e-9) AS INT), 1))", "ARRAY<DOUBLE>"),
    ("q_var", f"{R}, confidence DOUBLE DEFAULT 0.95", "-array_max(q_worst(xs, confidence))", "DOUBLE"),
    ("q_cvar", f"{R}, confidence DOUBLE DEFAULT 0.95", "-q_mean(q_worst(xs, confidence))", "DOUBLE"),
    ("q_moic", "invested DOUBLE, returned DOUBLE", "CASE WHEN invested > 0 THEN returned / invested END", "DOUBLE"),
    ("q_dpi", "flows ARRAY<DOUBLE>", "try_divide(" + _SUM.format("filter(flows, x -> x > 0)") + ", nullif(-" + _SUM.format("filter(flows, x -> x < 0)") + ", 0D))", "DOUBLE"),
]


def _sharpe(r: np.ndarray, rf: float = 0.0, periods: float = 244) -> float:
    sd = r.std(ddof=1) if len(r) > 1 else 0.0
    return (r.mean() - rf / periods) / sd * math.sqrt(periods) if sd > 1e-12 else math.nan


def _drawdown(r: np.ndarray) -> float:
    top = np.maximum.accumulate(r)
    return float((1 - r / top).max()) if len(r) else math.nan


def _worst(r: np.ndarray, confidence: float) -> np.ndarray:
    return np.sort(r)[: max(1, math.ceil((1 - confidence) * len(r) - 1e-9))]


def _parametric(r: np.ndarray, confidence: float = 0.95, horizon: float = 1) -> float:
    return -(r.mean() + NormalDist().inv_cdf(1 - confidence) * r.std(ddof=1)) * math.sqrt(horizon) if len(r) > 1 else math.nan


def _sortino(r: np.ndarray, target: float = 0.0, periods: float = 244) -> float:
    down = math.sqrt(np.mean(np.minimum(r - target, 0) ** 2)) if len(r) else 0.0
    return (r.mean() - target) / down * math.sqrt(periods) if down > 0 else math.nan


def _bounded(low: float, high: float):
    return lambda x: low < x < high


#: By name: the measure and its parameters with the test of a given value.
MEASURES = {
    "sharpe": (_sharpe, {"rf": math.isfinite, "periods": _bounded(0, math.inf)}),
    "sortino": (_sortino, {"target": math.isfinite, "periods": _bounded(0, math.inf)}),
    "mdd": (_drawdown, {}),
    "var": (lambda r, confidence=0.95: -_worst(r, confidence)[-1] if len(r) else math.nan, {"confidence": _bounded(0, 1)}),
    "cvar": (lambda r, confidence=0.95: -_worst(r, confidence).mean() if len(r) else math.nan, {"confidence": _bounded(0, 1)}),
    "var_param": (_parametric, {"confidence": _bounded(0, 1), "horizon": _bounded(0, math.inf)}),
    "norm_ppf": (lambda r: NormalDist().inv_cdf(r[0]) if len(r) and 0 < r[0] < 1 else math.nan, {}),
}


class Quant:
    """``measure, value`` of one array by a measure's name."""

    @staticmethod
    def analyze(name: AnalyzeArgument, values: AnalyzeArgument, **params: AnalyzeArgument) -> AnalyzeResult:
        if name.value not in MEASURES:
            raise ValueError(f"no measure {name.value!r}; there are {', '.join(MEASURES)}")
        tests = MEASURES[name.value][1]
        for k, given in params.items():
            if k not in tests:
                raise ValueError(f"{name.value} has no parameter {k!r}")
            if given.isConstantExpression and not tests[k](float(given.value)):
                raise ValueError(f"{k} = {given.value} is out of range for {name.value}")
        return AnalyzeResult(StructType().add("measure", StringType()).add("value", DoubleType()))

    def eval(self, name: str, values: list, **params: float) -> Iterator[tuple]:
        x = np.array([v for v in values or [] if v is not None], float)
        got = float(MEASURES[name][0](x, **{k: float(v) for k, v in params.items()}))
        yield name, None if math.isnan(got) else got


class ChipHistogram:
    """``symbol, bucket, price, mass`` of a table of bars with a ``turnover``, dealt by symbol and sorted by date."""

    COLUMNS = ["symbol", "trade_date", "high", "low", "close", "turnover"]

    @staticmethod
    def analyze(bars: AnalyzeArgument, buckets: AnalyzeArgument | None = None, lookback: AnalyzeArgument | None = None) -> AnalyzeResult:
        missing = [c for c in ChipHistogram.COLUMNS if c not in bars.dataType.fieldNames()]
        if missing:
            raise ValueError(f"the table needs {', '.join(missing)}")
        for k, given in (("buckets", buckets), ("lookback", lookback)):
            if given is not None and (given.value is None or int(given.value) < 2):
                raise ValueError(f"{k} must be 2 or more")
        out = StructType().add("symbol", StringType()).add("bucket", IntegerType()).add("price", DoubleType()).add("mass", DoubleType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("trade_date")])

    def __init__(self) -> None:
        self.held: deque = deque()
        self.symbol, self.buckets = None, 150

    def eval(self, bars, buckets: int = 150, lookback: int = 120) -> Iterator[tuple]:
        self.symbol, self.buckets = bars["symbol"], buckets
        self.held.append([bars["high"], bars["low"], bars["close"], bars["turnover"]])
        if len(self.held) > lookback:
            self.held.popleft()
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if not self.held:
            return
        high, low, close, turnover = np.array(self.held, float).T
        turnover = np.clip(turnover, 0, 0.999999)
        later = np.concatenate([np.cumsum(np.log(1 - turnover[::-1]))[::-1][1:], [0.0]])
        left = turnover * np.exp(later)
        step = (high.max() - low.min()) / (self.buckets - 1)
        price = low.min() + np.arange(self.buckets) * step
        mid, width = (high + low + 2 * close) / 4, (high - low) + step
        inside = (price >= (low - step / 2)[:, None]) & (price <= (high + step / 2)[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(inside, np.maximum(1e-9, 1 - np.abs(price - mid[:, None]) / width[:, None]), 0.0)
            mass = (weight / weight.sum(axis=1, keepdims=True) * left[:, None]).sum(axis=0)
            mass = mass / mass.sum()
        for k in range(self.buckets):
            yield self.symbol, k, float(price[k]), None if math.isnan(mass[k]) else float(mass[k])


def register(spark: SparkSession) -> None:
    for name, params, body, kind in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("quant", udtf(Quant))
    spark.udtf.register("chip_histogram", udtf(ChipHistogram))
