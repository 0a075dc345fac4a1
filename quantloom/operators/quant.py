"""Performance, risk and cash-flow measures as aggregates, and option values by vectorised Python where SQL has no erf."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = 244
_N = NormalDist()


def annualized_return(r: Column, periods: int = PERIODS) -> Column:
    """prod(1 + r)^(periods / n) - 1; null where the product isn't positive."""
    total = F.product(1 + r)
    return F.when(total > 0, F.pow(total, F.try_divide(F.lit(float(periods)), F.count(r))) - 1)


def annualized_volatility(r: Column, periods: int = PERIODS) -> Column:
    return F.stddev_samp(r) * math.sqrt(periods)


def sharpe(r: Column, rf: float = 0.0, periods: int = PERIODS) -> Column:
    """Null for a flat series."""
    sd = F.stddev_samp(r)
    excess = F.avg(r) - F.lit(rf / periods)
    return F.when(sd > 1e-12 * F.greatest(F.abs(F.avg(r)), F.lit(1.0)), F.try_divide(excess, sd) * math.sqrt(periods))


def sortino(r: Column, target: float = 0.0, periods: int = PERIODS) -> Column:
    short = F.when(r.isNotNull(), F.least(r - target, F.lit(0.0)))  # least() skips nulls
    down = F.sqrt(F.avg(F.pow(short, F.lit(2.0))))
    return F.try_divide(F.avg(r) - target, F.when(down > 0, down)) * math.sqrt(periods)


def parametric_var(r: Column, confidence: float = 0.95, horizon: int = 1) -> Column:
    z = _N.inv_cdf(1 - confidence)
    return -(F.avg(r) + z * F.stddev_samp(r)) * math.sqrt(horizon)


def ranked_losses(df: DataFrame, key: str, r: str, confidence: float = 0.95) -> DataFrame:
    """``var`` and ``cvar`` by key: the order statistic ceil((1 - c) n) - 1 of the returns and the mean up to it, negated."""
    n = F.count(r).over(Window.partitionBy(key))
    t = df.where(F.col(r).isNotNull()).withColumn("n", n).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(r)))
    cut = F.greatest(F.ceil(F.lit(1 - confidence) * F.col("n") - F.lit(1e-9)), F.lit(1))
    t = t.where(F.col("k") <= cut)
    return t.groupBy(key).agg((-F.max(r)).alias("var"), (-F.avg(r)).alias("cvar"))


def drawdown(df: DataFrame, key: str, order: str, equity: str) -> DataFrame:
    """``mdd`` by key, a positive fraction."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = df.withColumn("dd", 1 - F.try_divide(F.col(equity), F.max(equity).over(w)))
    return t.groupBy(key).agg(F.max("dd").alias("mdd"))


def moic(invested: Column, returned: Column) -> Column:
    return F.when(invested > 0, F.try_divide(returned, invested))


def dpi(amount: Column) -> Column:
    out = -F.sum(F.when(amount < 0, amount).otherwise(0.0))
    return F.when(out > 0, F.try_divide(F.sum(F.when(amount > 0, amount).otherwise(0.0)), out))


def tvpi(amount: Column, residual: Column) -> Column:
    out = -F.sum(F.when(amount < 0, amount).otherwise(0.0))
    return F.when(out > 0, F.try_divide(F.sum(F.when(amount > 0, amount).otherwise(0.0)) + F.max(residual), out))


def _roots(f, n: int, lo: float, hi: float) -> np.ndarray:
    """Roots between ``lo`` and ``hi`` of ``n`` functions by bisection, all at once; NaN where the ends have no change of sign.

    ``f(i, x)``: the values of the functions numbered ``i`` at the places ``x``. Those that are done are not asked again.
    """
    out, i = np.full(n, np.nan), np.arange(n)
    lo, hi = np.full(n, lo), np.full(n, hi)
    with np.errstate(all="ignore"):
        a, b = f(i, lo), f(i, hi)
        open_ = np.isfinite(a) & np.isfinite(b) & ~(a * b > 0)
        for _ in range(200):
            i, lo, hi, a = i[open_], lo[open_], hi[open_], a[open_]
            if not len(i):
                break
            mid = (lo + hi) / 2
            c = f(i, mid)
            open_ = ~((c == 0) | (hi - lo < 1e-13 * np.maximum(1.0, np.abs(mid))))
            out[i] = mid
            same = a * c > 0
            lo, hi, a = np.where(same, mid, lo), np.where(same, hi, mid), np.where(same, c, a)
        else:
            out[i[open_]] = ((lo + hi) / 2)[open_]
    return out


#: Flows whose keys are solved together.
FLOWS = 1 << 18


def xirr(flows: DataFrame, key: str, day: str, amount: str) -> DataFrame:
    """``key, rate``: the yearly rate (days over 365) at which the flows are worth nothing. Same-day flows are summed before.

    A key's days meet in one row, and the keys of an Arrow batch are solved together.
    """
    daily = flows.groupBy(key, F.col(day).cast("timestamp_ntz").alias("day")).agg(F.sum(amount).cast("double").alias("amount"))
    t = daily.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("day", "amount"))).alias("xs")).select(key, "xs.day", "xs.amount")

    def solved(size: np.ndarray, days: np.ndarray, a: np.ndarray) -> np.ndarray:
        start = np.cumsum(size) - size
        up, down = np.maximum.reduceat(np.nan_to_num(a), start), np.minimum.reduceat(np.nan_to_num(a), start)

        def worth(i: np.ndarray, r: np.ndarray) -> np.ndarray:
            n = size[i]
            first = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(start[i] - first, n)
            return np.add.reduceat(a[at] / np.repeat(1 + r, n) ** days[at], first)

        turns = np.flatnonzero((up > 0) & (down < 0))
        out = np.full(len(size), np.nan)
        out[turns] = _roots(lambda i, r: worth(turns[i], r), len(turns), -0.9999, 1e6) if len(turns) else np.nan
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column(1).offsets.to_numpy()).astype(np.int64) + 1
            # A zero of day zero leads each key's flows, so that sums begin with it.
            lead = np.cumsum(size) - size
            flow = np.ones(size.sum(), bool)
            flow[lead] = False
            at = np.zeros(len(flow), "datetime64[us]")
            at[flow] = b.column(1).flatten().to_numpy(zero_copy_only=False)
            past = at - np.repeat(at[lead + 1], size)
            days = np.where(np.isnat(past), np.nan, np.floor(past / np.timedelta64(1, "D"))) / 365.0
            a = np.zeros(len(flow))
            a[flow] = b.column(2).flatten().to_numpy(zero_copy_only=False)
            days[lead] = 0.0
            rate = [np.empty(0)]
            for some in np.split(np.arange(len(size)), np.flatnonzero(np.diff(lead // FLOWS)) + 1):
                if len(some):
                    x = slice(lead[some[0]], lead[some[-1]] + size[some[-1]])
                    rate.append(solved(size[some], days[x], a[x]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(rate), from_pandas=True)], [key, "rate"])

    return t.mapInArrow(run, f"`{key}` {flows.schema[key].dataType.simpleString()}, rate double")


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.fromiter(map(math.erfc, (-x / math.sqrt(2)).tolist()), float, len(x))


def _price(s, k, t, r, v, call, q=0.0):
    with np.errstate(divide="ignore", invalid="ignore"):
        d1 = (np.log(s / k) + (r - q + v * v / 2) * t) / (v * np.sqrt(t))
        d2 = d1 - v * np.sqrt(t)
    sign = np.where(call, 1.0, -1.0)
    flat = (t <= 0) | (v <= 0)
    d1, d2 = np.where(flat, 0.0, d1), np.where(flat, 0.0, d2)
    full = sign * (s * np.exp(-q * t) * _cdf(sign * d1) - k * np.exp(-r * t) * _cdf(sign * d2))
    return np.where(flat, np.maximum(sign * (s - k), 0.0), full)


def option_values(df: DataFrame) -> DataFrame:
    """``price, delta, gamma, theta, vega, rho, iv`` beside ``s, k, t, r, v, call``: Black-Scholes-Merton, theta by day, vega and rho by point.

    ``iv`` recovers the volatility from the price; null where the price doesn't tell it. Without time or volatility the
    value is the intrinsic one and the other measures are null. A batch's volatilities are recovered together, and rows are
    dealt to all cores, since few bytes of input are much work.
    """
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s, k, t, r, v = (b[c].to_numpy(float) for c in ("s", "k", "t", "r", "v"))
            call = b["call"].to_numpy(bool)
            sign = np.where(call, 1.0, -1.0)
            price = _price(s, k, t, r, v, call)
            ok = (t > 0) & (v > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                d1 = np.where(ok, (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t)), np.nan)
            d2 = d1 - v * np.sqrt(t)
            pdf = np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)
            disc = k * np.exp(-r * t)
            out = b.copy()
            out["price"] = price
            out["delta"] = sign * _cdf(sign * d1)
            out["gamma"] = pdf / (s * v * np.sqrt(t))
            out["theta"] = (-s * pdf * v / (2 * np.sqrt(t)) - sign * r * disc * _cdf(sign * d2)) / 365
            out["vega"] = s * pdf * np.sqrt(t) / 100
            out["rho"] = sign * t * disc * _cdf(sign * d2) / 100
            told = np.flatnonzero(ok & (out["vega"].to_numpy() > 1e-8))
            iv = np.full(len(b), np.nan)
            gap = lambda i, x: _price(s[i], k[i], t[i], r[i], x, call[i]) - price[i]
            iv[told] = _roots(lambda i, x, told=told, gap=gap: gap(told[i], x), len(told), 1e-6, 5.0)
            out["iv"] = iv
            yield out.astype(object).where(pd.notna(out), None)

    more = "price double, delta double, gamma double, theta double, vega double, rho double, iv double"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(*names).repartition(df.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, f"{fields}, {more}")


# The spellings of both kinds of option.
OPTION_TYPES = {**dict.fromkeys(["call", "calls", "c", "看涨", "认购"], "call"), **dict.fromkeys(["put", "puts", "p", "看跌", "认沽"], "put")}


def option_type(x: Column) -> Column:
    """``call`` or ``put``; any other spelling is an error."""
    words = F.create_map(*[F.lit(y) for kv in OPTION_TYPES.items() for y in kv])
    return F.coalesce(words[F.lower(F.trim(x))], F.raise_error(F.concat(F.lit("no option type: "), F.coalesce(x, F.lit("null")))))


def drawdown_location(df: DataFrame, key: str, order: str, equity: str) -> DataFrame:
    """``key, mdd, duration, peak, trough``: the deepest fall (the first of equal ones), in rows from the first highest one to the lowest."""
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    t = df.where(F.col(equity).isNotNull()).withColumn("__i", F.row_number().over(w)).withColumn("__top", F.max(equity).over(so_far))
    t = t.withColumn("__new", (F.lag("__top").over(w) < F.col("__top")) | (F.col("__i") == 1))
    at = lambda x: F.last(F.when(F.col("__new"), F.col(x)), ignorenulls=True).over(so_far)
    row = F.struct((F.col(equity) / F.col("__top") - 1).alias("d"), F.col("__i").alias("i"), (F.col("__i") - at("__i")).alias("n"), at(order).alias("peak"), F.col(order).alias("trough"))
    t = t.select(key, row.alias("r")).groupBy(key).agg(F.min("r").alias("r"))
    return t.select(key, (-F.col("r.d")).alias("mdd"), F.col("r.n").alias("duration"), F.col("r.peak").alias("peak"), F.col("r.trough").alias("trough"))


def irr(flows: DataFrame, key: str, order: str, amount: str, steps: int = 200) -> DataFrame:
    """``key, rate``: the rate by period at which equally spaced flows are worth nothing, by bisection between -0.9999 and 10^6;
    null without a change of sign. A key's flows meet in one row."""
    t = flows.where(F.col(amount).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(amount).alias("a")))).alias("xs"))
    t = t.select(key, F.col("xs.a").alias("xs"))
    worth = lambda r: F.aggregate(F.reverse("xs"), F.lit(0.0), lambda s, x: s / (1 + r) + x)  # noqa: E731  (Horner's rule from the last flow)
    low, high = F.lit(-0.9999), F.lit(1e6)
    up = F.signum(worth(low))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        same = F.signum(worth(mid)) == up
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid).alias("hi"))

    turns = F.exists("xs", lambda x: x > 0) & F.exists("xs", lambda x: x < 0) & (up != F.signum(worth(high)))
    both = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.alias("lo"), high.alias("hi")), step)
    return t.select(key, F.when(turns, (both["lo"] + both["hi"]) / 2).alias("rate"))
