"""Windows over a long panel (symbol, trade_date) and the aggregates that pandas' min_periods asks for."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("trade_date")


def last(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def by_date() -> WindowSpec:
    return Window.partitionBy("trade_date")


def full(x: Column, n: int, value: Column) -> Column:
    """``value`` where the last ``n`` rows all have an ``x``; else null."""
    return F.when(F.count(x).over(last(n)) == n, value)


def mean(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x).over(last(n)))


def total(x: Column, n: int) -> Column:
    return full(x, n, F.sum(x).over(last(n)))


def std(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_samp(x).over(last(n)))


def highest(x: Column, n: int) -> Column:
    return full(x, n, F.max(x).over(last(n)))


def lowest(x: Column, n: int) -> Column:
    return full(x, n, F.min(x).over(last(n)))


def lag(x: Column, d: int) -> Column:
    if d < 1:
        raise ValueError("a delay of less than one bar looks ahead")
    return F.lag(x, d).over(by_symbol())


def safe_div(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """a / (b + eps * sign(b)); null where b is 0."""
    return F.try_divide(a, b + F.lit(eps) * F.signum(b))


def js_round(x: Column, digits: int = 3) -> Column:
    """Half up, also below zero: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
