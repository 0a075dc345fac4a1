"""Recursive series: functions from arrays of one symbol, oldest first, to arrays. NaN stands for missing inside them.

``scan`` applies one to every symbol of a panel, which the parabolic stop needs: its state isn't affine. A symbol is
one group; its size is the number of its bars, which time bounds, not the volume of trades that a bar sums up. The
other loops are the plain forms of the native scans (``recursions``), which tests hold against them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NAN = float("nan")


def scan(panel: DataFrame, columns: list[str], outputs: list[str], fold: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """``symbol, trade_date`` and ``outputs`` (double, null for NaN), from ``fold(**columns)``."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("trade_date")
        got = fold(**{c: t[c].to_numpy(float) for c in columns})
        out = pd.DataFrame({"symbol": t["symbol"].to_numpy(), "trade_date": t["trade_date"].to_numpy()})
        for o in outputs:
            values = pd.Series(got[o]).astype(object)
            out[o] = values.where(pd.notna(values), None)
        return out

    kinds = "symbol string, trade_date date, " + ", ".join(f"{o} double" for o in outputs)
    return panel.select("symbol", "trade_date", *columns).groupBy("symbol").applyInPandas(run, kinds)


def rounded(x: np.ndarray, digits: int = 3) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def ema_seeded(x: np.ndarray, n: int) -> np.ndarray:
    """Seeded with the mean of the first n values that all are there; a missing value repeats the last result."""
    out, state = np.full(len(x), NAN), NAN
    alpha = 2 / (n + 1)
    for i, v in enumerate(x):
        if math.isnan(state):
            if i + 1 >= n and not np.isnan(x[i + 1 - n : i + 1]).any():
                state = float(np.mean(x[i + 1 - n : i + 1]))
        elif not math.isnan(v):
            state = alpha * v + (1 - alpha) * state
        out[i] = state
    return out


def ema_first(x: np.ndarray, alpha: float) -> np.ndarray:
    """Starts from the first value."""
    out, state = np.full(len(x), NAN), NAN
    for i, v in enumerate(x):
        if not math.isnan(v):
            state = v if math.isnan(state) else alpha * v + (1 - alpha) * state
        out[i] = state
    return out


def macd_seeded(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, np.ndarray]:
    dif = rounded(ema_seeded(x, fast)) - rounded(ema_seeded(x, slow))
    dea = rounded(ema_seeded(dif, signal))
    return {"dif": rounded(dif), "dea": dea, "macd": rounded(2 * (dif - dea))}


def rsi_wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Seeded with the means of the first n changes. No loss gives 100, no gain 0."""
    out = np.full(len(x), NAN)
    if len(x) <= n:
        return out
    change = np.diff(x)
    gain, loss = np.maximum(change, 0), np.maximum(-change, 0)
    g, l = float(np.mean(gain[:n])), float(np.mean(loss[:n]))
    for i in range(n, len(x)):
        if i > n:
            g, l = (g * (n - 1) + gain[i - 1]) / n, (l * (n - 1) + loss[i - 1]) / n
        out[i] = 100.0 if l == 0 else 0.0 if g == 0 else 100 - 100 / (1 + g / l)
    return out


def smoothed(x: np.ndarray, n: int, start: float) -> np.ndarray:
    """(state * (n - 1) + x) / n from ``start``; a missing value gives a missing one and keeps the state."""
    out, state = np.full(len(x), NAN), start
    for i, v in enumerate(x):
        if not math.isnan(v):
            state = (state * (n - 1) + v) / n
            out[i] = state
    return out


def raw_stochastic(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(close), NAN)
    for i in range(n - 1, len(close)):
        top, bottom = high[i + 1 - n : i + 1].max(), low[i + 1 - n : i + 1].min()
        if top > bottom:
            out[i] = (close[i] - bottom) / (top - bottom) * 100
    return out


def kdj(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 9, m1: int = 3, m2: int = 3) -> dict[str, np.ndarray]:
    k = smoothed(raw_stochastic(high, low, close, n), m1, 50.0)
    d = smoothed(k, m2, 50.0)
    return {"k": k, "d": d, "j": 3 * k - 2 * d}


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[NAN], close[:-1]])
    out = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    if len(out):
        out[0] = high[0] - low[0]
    return out


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the first n values, then (state * (n - 1) + x) / n; a missing value holds the state."""
    out, state = np.full(len(x), NAN), NAN
    for i, v in enumerate(x):
        if math.isnan(state):
            if i + 1 >= n and not np.isnan(x[i + 1 - n : i + 1]).any():
                state = float(np.mean(x[i + 1 - n : i + 1]))
        elif not math.isnan(v):
            state = (state * (n - 1) + v) / n
        out[i] = state
    return out


def wilder_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of x[1..n], then state - state / n + x."""
    out = np.full(len(x), NAN)
    if len(x) > n:
        state = float(np.sum(x[1 : n + 1]))
        out[n] = state
        for i in range(n + 1, len(x)):
            state = state - state / n + x[i]
            out[i] = state
    return out


def dmi(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14, m: int = 14) -> dict[str, np.ndarray]:
    """Directional movement: Wilder sums, DX, its mean ADX (seeded with a mean of m) and ADXR against m bars before."""
    size = len(close)
    up, down = np.zeros(size), np.zeros(size)
    if size > 1:
        rise, fall = np.diff(high), -np.diff(low)
        up[1:] = np.where((rise > fall) & (rise > 0), rise, 0)
        down[1:] = np.where((fall > rise) & (fall > 0), fall, 0)
    tr = wilder_sum(true_range(high, low, close), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        pdi = np.where(tr > 0, 100 * wilder_sum(up, n) / tr, NAN)
        mdi = np.where(tr > 0, 100 * wilder_sum(down, n) / tr, NAN)
        dx = np.where(pdi + mdi > 0, 100 * np.abs(pdi - mdi) / (pdi + mdi), np.where(np.isnan(pdi), NAN, 0.0))
    adx = wilder(dx, m)
    adxr = np.full(size, NAN)
    if size > m:
        adxr[m:] = (adx[m:] + adx[:-m]) / 2
    return {"pdi": pdi, "mdi": mdi, "adx": adx, "adxr": adxr}


def sar(high: np.ndarray, low: np.ndarray, start: float = 0.02, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """Parabolic stop and reverse, first long if the second high is above the first."""
    size = len(high)
    out = np.full(size, NAN)
    if size < 2:
        return out
    long = high[1] >= high[0]
    stop, extreme, factor = (low[0], high[1], start) if long else (high[0], low[1], start)
    out[1] = stop
    for i in range(2, size):
        stop = stop + factor * (extreme - stop)
        if long:
            stop = min(stop, low[i - 1], low[i - 2])
            if low[i] < stop:
                long, stop, extreme, factor = False, extreme, low[i], start
            elif high[i] > extreme:
                extreme, factor = high[i], min(most, factor + step)
        else:
            stop = max(stop, high[i - 1], high[i - 2])
            if high[i] > stop:
                long, stop, extreme, factor = True, extreme, high[i], start
            elif low[i] < extreme:
                extreme, factor = low[i], min(most, factor + step)
        out[i] = stop
    return out
