"""Panel operators: cross-sectional (cs_*), time-series (ts_*) and elementwise, as Column builders.

A panel is long: a row for each symbol and trade_date. Windows count the rows that are there; where a symbol may miss
dates, ``densify`` first. NaN has no place here: missing is null. Windows of n rows give null until n values are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import windows as w


def densify(panel: DataFrame) -> DataFrame:
    """A row for each pair of a symbol and a date that occur; the fields of new rows are null."""
    dates = panel.select("trade_date").distinct()
    symbols = panel.select("symbol").distinct()
    # The grid is the result itself: symbols times dates, as many rows as a full panel has.
    grid = symbols.join(dates, F.lit(True), "inner")
    return grid.join(panel, ["symbol", "trade_date"], "left")


def cs_rank(x: Column) -> Column:
    """Average-tie percentile of the row's date, null for null."""
    at = F.rank().over(w.by_date().orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy("trade_date", x))
    return F.when(x.isNotNull(), (at + (ties - 1) / 2) / F.count(x).over(w.by_date()))


def cs_zscore(x: Column) -> Column:
    sd = F.stddev_samp(x).over(w.by_date())
    return F.when(sd > 0, (x - F.avg(x).over(w.by_date())) / sd)


def cs_scale(x: Column, a: float = 1.0) -> Column:
    square = F.sum(x * x).over(w.by_date())
    return F.when(square > 0, F.lit(a) * x / F.sqrt(square))


def _window_list(x: Column, n: int) -> Column:
    return F.collect_list(x).over(w.last(n))


def ts_rank(x: Column, n: int) -> Column:
    """Average-tie percentile of the last value among the last n."""
    xs = _window_list(x, n)
    below, same = F.size(F.filter(xs, lambda v: v < x)), F.size(F.filter(xs, lambda v: v == x))
    return w.full(x, n, (below + 0.5 * (same + 1)) / n)


def ts_argmax(x: Column, n: int) -> Column:
    """Place, from the oldest bar, of the first maximum."""
    xs = _window_list(x, n)
    return w.full(x, n, F.array_position(xs, F.array_max(xs)) - 1)


def ts_argmin(x: Column, n: int) -> Column:
    xs = _window_list(x, n)
    return w.full(x, n, F.array_position(xs, F.array_min(xs)) - 1)


def decay_linear(x: Column, n: int, newest_heaviest: bool = False) -> Column:
    """Weights n, n-1, ... 1 from the oldest bar on (the usual definition with ``newest_heaviest``)."""
    parts = [(n - k if newest_heaviest else k + 1) * (F.lag(x, k).over(w.by_symbol()) if k else x) for k in range(n)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out / F.lit(n * (n + 1) / 2)


def signed_power(x: Column, p: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def _paired(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def ts_cov(x: Column, y: Column, n: int) -> Column:
    x, y = _paired(x, y)
    return w.full(x, n, F.covar_samp(x, y).over(w.last(n)))


def ts_corr(x: Column, y: Column, n: int) -> Column:
    """Pearson correlation; null where either side is constant."""
    x, y = _paired(x, y)
    spread = F.stddev_samp(x).over(w.last(n)) * F.stddev_samp(y).over(w.last(n))
    return w.full(x, n, F.try_divide(F.covar_samp(x, y).over(w.last(n)), spread))


def vwap(market: str = "equity_cn", columns: tuple[str, ...] = ("open", "high", "low", "close", "volume", "amount")) -> Column:
    """Amount over volume with the units of mainland equities (thousands and lots), else the mean of the four prices."""
    if market == "equity_cn":
        if not {"volume", "amount"} <= set(columns):
            raise KeyError("vwap needs volume and amount")
        return F.col("amount") * 1000 / (F.col("volume") * 100 + 1)
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
