"""Backtests, price distributions and momentum hedging.

Signals and benchmarks are windows; only the account, whose orders depend on its cash, is a fold over a symbol's bars.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.operators import indicators

_c = F.col
COMMISSION, LEAST_FEE, STAMP, LOT, LIMIT, LIMIT_EPS = 0.00025, 5.0, 0.0005, 100, 0.10, 1e-6
OUT = "symbol string, final double, total_return double, annual_return double, mdd double, sharpe double, n_trades long, win_rate double, benchmark double"


def with_signals(bars: DataFrame, strategy: str, fast: int = 5, slow: int = 20, n: int = 20) -> DataFrame:
    """``bars`` with ``signal``: 1 to buy, -1 to sell, 0 to stay, at the close of each bar."""
    if strategy == "buy_hold":
        first = F.row_number().over(w.by_symbol()) == 1
        return bars.withColumn("signal", F.when(first, 1).otherwise(0))
    if strategy == "ma_cross":
        bars = bars.withColumn("__d", w.mean(_c("close"), fast) - w.mean(_c("close"), slow))
        before = F.lag("__d").over(w.by_symbol())
        up, down = (before <= 0) & (_c("__d") > 0), (before >= 0) & (_c("__d") < 0)
        return bars.withColumn("signal", F.when(up, 1).when(down, -1).otherwise(0)).drop("__d")
    if strategy == "momentum":
        change = F.try_divide(_c("close"), F.lag("close", n).over(w.by_symbol())) - 1
        return bars.withColumn("signal", F.when(change > 0, 1).when(change < 0, -1).otherwise(0))
    if strategy == "rsi_reverse":
        b = indicators.Build()
        rsi = indicators.wilder_rsi(b, 14)
        return b.run(bars).select(*[_c(f"`{c}`") for c in bars.columns], F.when(rsi < 30, 1).when(rsi > 70, -1).otherwise(0).alias("signal"))
    raise ValueError(f"no strategy {strategy!r}")


def fee(amount: float, sell: bool) -> float:
    return max(amount * COMMISSION, LEAST_FEE) + (amount * STAMP if sell else 0.0)


Strategy = Callable[[pd.DataFrame, int, dict], str]


def account(opens: np.ndarray, closes: np.ndarray, signals: np.ndarray | Callable[[int], int], capital: float, at_first_open: bool = False) -> tuple[np.ndarray, list[float]]:
    """Equity at each close (in cents) and the profit of each round trip.

    A signal is filled at the next open: a purchase unless that lies LIMIT above the last close, with all whole lots that
    cash and fees allow; a sale of all unless it lies LIMIT below. Otherwise it is dropped. Signals to buy while holding or to sell
    while not are none. ``at_first_open`` buys at the first open without a signal. The last close sells what wasn't bought that day.
    """
    signal = signals if callable(signals) else lambda i: signals[i]
    cash, held, cost, bought, pending = capital, 0, 0.0, -1, 0
    equity, profits = np.zeros(len(closes)), []

    def buy(i: int, price: float) -> None:
        nonlocal cash, held, cost, bought
        lots = int(cash // (price * LOT)) if price > 0 else 0
        while lots and lots * LOT * price + fee(lots * LOT * price, False) > cash + 1e-9:
            lots -= 1
        if lots:
            held, bought = lots * LOT, i
            cost = held * price + fee(held * price, False)
            cash -= cost

    def sell(price: float) -> None:
        nonlocal cash, held
        got = held * price - fee(held * price, True)
        cash += got
        profits.append(got - cost)
        held = 0

    for i in range(len(closes)):
        if pending:
            change = opens[i] / closes[i - 1] - 1 if closes[i - 1] > 0 else 0.0
            if pending > 0 and not held and change < LIMIT - LIMIT_EPS:
                buy(i, opens[i])
            elif pending < 0 and held and i > bought and change > LIMIT_EPS - LIMIT:
                sell(opens[i])
        if at_first_open and i == 0:
            buy(0, opens[0])
        s = signal(i)
        pending = 1 if s > 0 and not held else -1 if s < 0 and held else 0
        equity[i] = round(cash + held * closes[i], 2)
    if held and bought != len(closes) - 1:
        sell(closes[-1])
        equity[-1] = round(cash, 2)
    return equity, profits


def run_backtest(bars: DataFrame, strategy: str | Strategy, capital: float = 1_000_000.0, periods: int = 244, **params: int) -> DataFrame:
    """A row of results for each symbol of ``symbol, trade_date, open, close``.

    ``strategy`` is a name, or a function of a symbol's bars so far and to come, the place of the current one and a dict
    that is its own for the symbol, which returns buy, sell or hold at that bar's close; it must not look ahead. One that
    fails holds. Such a function gets all columns of ``bars``, oldest first.
    """
    own = callable(strategy)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("trade_date", ignore_index=True)
        o, c = t["open"].to_numpy(float), t["close"].to_numpy(float)
        state: dict = {"symbol": t["symbol"].iloc[0]}

        def asked(i: int) -> int:
            try:
                return {"buy": 1, "sell": -1}.get(strategy(t, i, state), 0)
            except Exception:  # noqa: BLE001 - the user's code; a bar that it can't judge is held
                return 0

        equity, profits = account(o, c, asked if own else t["signal"].to_numpy(), capital, at_first_open=strategy == "buy_hold")
        r = equity[1:] / equity[:-1] - 1
        peak = np.maximum.accumulate(equity)
        total = equity[-1] / capital - 1
        sd = r.std(ddof=1) if len(r) > 1 else 0.0
        row = {
            "symbol": t["symbol"].iloc[0], "final": equity[-1], "total_return": total, "annual_return": (1 + total) ** (periods / len(c)) - 1 if total > -1 and len(c) > 1 else None,
            "mdd": float(((peak - equity) / peak).max()), "sharpe": float(r.mean() / sd * math.sqrt(periods)) if sd > 1e-12 else None, "n_trades": len(profits),
            "win_rate": sum(p > 0 for p in profits) / len(profits) if profits else None, "benchmark": c[-1] / c[0] - 1,
        }
        return pd.DataFrame([row])

    t = bars.where("close is not null").dropDuplicates(["symbol", "trade_date"])
    if not own:
        t = with_signals(t, strategy, **params).select("symbol", "trade_date", "open", "close", "signal")
    return t.groupBy("symbol").applyInPandas(run, OUT)


def buy_hold(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg((F.try_divide(F.max_by("close", "trade_date"), F.min_by("close", "trade_date")) - 1).alias("benchmark"))


def chip_distribution(bars: DataFrame, buckets: int = 150, lookback: int = 120) -> DataFrame:
    """``symbol, bucket, price, mass``: what share of the float changed hands last in each price bucket.

    Each of the last ``lookback`` bars puts its turnover on the buckets it touched, as a triangle about its mean price,
    and thins out by the turnover of every later bar: mass = turnover * prod(1 - later turnover), a window over logs.
    """
    newest = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    t = bars.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= lookback)
    turnover = F.least(F.greatest(_c("turnover"), F.lit(0.0)), F.lit(0.999999))
    later = F.sum(F.log(1 - turnover)).over(newest.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("left", turnover * F.exp(F.coalesce(later, F.lit(0.0))))
    every = Window.partitionBy("symbol")
    t = t.withColumns({"lo": F.min("low").over(every), "hi": F.max("high").over(every)})
    t = t.withColumn("step", (_c("hi") - _c("lo")) / (buckets - 1)).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    price = _c("lo") + _c("bucket") * _c("step")
    mid = (_c("high") + _c("low") + 2 * _c("close")) / 4
    inside = (price >= _c("low") - _c("step") / 2) & (price <= _c("high") + _c("step") / 2)
    weight = F.when(inside, F.greatest(F.lit(1e-9), 1 - F.try_divide(F.abs(price - mid), (_c("high") - _c("low")) + _c("step")))).otherwise(0.0)
    bar = Window.partitionBy("symbol", "trade_date")
    t = t.withColumns({"price": price, "weight": weight}).withColumn("share", F.try_divide(_c("weight"), F.sum("weight").over(bar)) * _c("left"))
    t = t.groupBy("symbol", "bucket").agg(F.first("price").alias("price"), F.sum("share").alias("mass"))
    return t.withColumn("mass", F.try_divide(_c("mass"), F.sum("mass").over(every)))


def chip_summary(distribution: DataFrame, close: DataFrame) -> DataFrame:
    """``symbol, profit_ratio, mean_cost, p05, p95, peak``; ``close``: ``symbol, close``."""
    running = F.sum("mass").over(Window.partitionBy("symbol").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    t = distribution.withColumn("cum", running).join(close, "symbol")
    at = lambda p: F.min(F.when(_c("cum") >= p - 1e-12, _c("price")))
    return t.groupBy("symbol").agg(
        F.sum(F.when(_c("price") <= _c("close"), _c("mass")).otherwise(0.0)).alias("profit_ratio"), F.sum(_c("price") * _c("mass")).alias("mean_cost"),
        at(0.05).alias("p05"), at(0.95).alias("p95"), F.max_by("price", F.struct("mass", -_c("bucket"))).alias("peak"),
    )


def momentum(n: int) -> Column:
    return F.try_divide(_c("close"), F.lag("close", n - 1).over(w.by_symbol())) - 1


def momentum_hedge(bars: DataFrame, top: int = 5) -> DataFrame:
    """For each date the ``top`` symbols by their change over five bars among those that rose over 20 bars; half the weight is theirs."""
    t = bars.withColumns({"m20": momentum(20), "m5": momentum(6)}).where("m20 > 0 and m5 is not null")
    rank = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("m5"), "symbol"))
    t = t.withColumn("rank", rank).where(F.col("rank") <= top)
    n = F.count("*").over(Window.partitionBy("trade_date"))
    return t.select("trade_date", "symbol", "rank", (F.lit(0.5) / n).alias("weight"))


def momentum_report(prices: DataFrame, benchmark: str, inverse: str, top: int = 5, lookback: int = 20, step: int = 5) -> DataFrame:
    """The hedged momentum portfolio at every rebalance: one row each, from ``symbol, trade_date, close``.

    The benchmark's dates are the calendar; its last date and every ``step`` th before it are rebalances. ``pool_size``
    counts symbols with two prices or more in the last ``lookback`` dates, ``top`` lists (by comma) the best by their change over
    ``step`` dates among those that rose over the lookback, both rounded to a tenth of a percent, ties by symbol. ``added, removed,
    kept``: against the rebalance before. ``strategy_w``: half the mean change of ``top``, half the inverse fund's.
    ``bench_w, inverse_w``: change over ``step`` - 1 dates, 0 where a price lacks. Prices that are null or 0 don't count.

    A price takes part in the few rebalances whose lookback holds it, so it is sent to these: one shuffle by symbol and
    rebalance, whatever the number of dates. Rebalances are few; one row each meets the next by a window.
    """
    t = prices.where("close is not null and close <> 0").select("symbol", "trade_date", "close")
    # One row for each date of the calendar; dates, not prices, are numbered in one place.
    days = t.where(_c("symbol") == benchmark).select("trade_date").distinct()
    days = days.withColumn("i", F.row_number().over(Window.orderBy("trade_date")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    t = t.join(days, "trade_date")
    # The rebalances at or after date i and before i + lookback.
    first = (_c("n") - 1) - F.floor((_c("n") - 1 - _c("i")) / step) * step
    t = t.withColumn("r", F.explode(F.sequence(first, F.least(_c("n") - 1, _c("i") + lookback - 1), F.lit(step)))).where(_c("r").between(_c("i"), _c("i") + lookback - 1))
    at = lambda back: F.max(F.when(_c("i") == F.greatest(_c("r") - back, F.lit(0)), _c("close")))
    # Tenths as SQL engines round doubles: round(x, 1) goes by x's decimal digits, and sums that end in a half fall either way.
    tenths = lambda x: F.round(x * 10) / 10
    change = lambda a, b: tenths((a / b - 1) * 100)
    s = t.groupBy("symbol", "r").agg(
        F.count("*").alias("k"), change(F.max_by("close", "i"), F.min_by("close", "i")).alias("m"), change(at(0), at(step)).alias("m_step"), change(at(0), at(step - 1)).alias("w"),
        F.max(F.when(_c("i") == _c("r"), _c("trade_date"))).alias("d"), F.max(F.when(_c("i") == F.greatest(_c("r") - step, F.lit(0)), _c("trade_date"))).alias("d0"),
    )
    funds = _c("symbol").isin(benchmark, inverse)
    rank = F.row_number().over(Window.partitionBy("r").orderBy(F.desc_nulls_last(F.when(~funds & (_c("k") > 1) & (_c("m") > 0), _c("m_step"))), "symbol"))
    s = s.withColumns({"ok": ~funds & (_c("k") > 1) & (_c("m") > 0) & _c("m_step").isNotNull(), "rank": rank})
    held = (_c("rank") <= top) & _c("ok")
    picked = F.array_sort(F.collect_list(F.when(held, F.struct("rank", "symbol", "m_step"))))
    names = F.transform(picked, lambda x: x["symbol"])
    # Added up by rank, so that the last digit doesn't depend on the order in which rows arrive.
    gain = F.try_divide(F.aggregate(picked, F.lit(0.0), lambda t, x: t + x["m_step"]), F.size(picked))
    of = lambda name, x: F.max(F.when(_c("symbol") == name, _c(x)))
    r = s.groupBy("r").agg(
        of(benchmark, "d").alias("date"), of(benchmark, "d0").alias("week_start"), F.count_if(~funds & (_c("k") > 1)).alias("pool_size"), names.alias("top"),
        F.coalesce(gain, F.lit(0.0)).alias("gain"), F.coalesce(of(benchmark, "w"), F.lit(0.0)).alias("bench_w"), F.coalesce(of(inverse, "w"), F.lit(0.0)).alias("inverse_w"),
    )
    before = F.coalesce(F.lag("top").over(Window.orderBy("r")), F.array().cast("array<string>"))
    r = r.withColumn("before", before)
    joined = lambda xs: F.array_join(xs, ",")
    return r.select(
        "date", "week_start", "pool_size", joined("top").alias("top"), joined(F.array_except("top", "before")).alias("added"), joined(F.array_sort(F.array_except("before", "top"))).alias("removed"),
        joined(F.array_intersect("top", "before")).alias("kept"), tenths(_c("gain") * 0.5 + _c("inverse_w") * 0.5).alias("strategy_w"), "bench_w", "inverse_w",
    )


def ledger(orders: DataFrame, key: str, order: list[str], cash: int) -> DataFrame:
    """``key, cash, held, cost, pnl, filled, refused``: accounts after their orders, each of which is filled or refused in turn.

    ``orders``: ``buy``, ``qty``, ``price`` in 1/10000 and ``fee`` in 1/10^7 of a cent, all whole numbers; ``cash`` is in cents. A
    buy needs the cash for its notional and fee and moves the mean cost (rounded to 1/10000); what is left is rounded to cents. A
    sale needs the quantity and realises the difference to the mean cost in cents. An account's orders meet in one row, since each
    depends on the one before.
    """
    unit = 10_000_000
    item = F.struct(*order, "buy", "qty", "price", "fee")
    t = orders.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    zero = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in {"cash": cash * unit, "held": 0, "cost": 0, "pnl": 0, "filled": 0, "refused": 0}.items()])
    down = lambda x, n: ((x - F.pmod(x, F.lit(n))) / n).cast("long")
    nearest = lambda x, n: down(2 * x + n, 2 * n)

    def step(s: Column, x: Column) -> Column:
        worth = x["price"] * x["qty"] * (unit // 100)
        bought, sold = x["buy"] & (s["cash"] >= worth + x["fee"]), ~x["buy"] & (s["held"] >= x["qty"])
        after = s["held"] + x["qty"]
        mixed = s["cost"] * s["held"] + x["price"] * x["qty"]
        mean = ((2 * mixed + after - F.pmod(2 * mixed + after, 2 * after)) / (2 * after)).cast("long")
        left = nearest(s["cash"] - worth - x["fee"], unit) * unit
        held = F.when(bought, after).when(sold, s["held"] - x["qty"]).otherwise(s["held"])
        return F.struct(
            F.when(bought, left).when(sold, s["cash"] + worth - x["fee"]).otherwise(s["cash"]).alias("cash"),
            held.alias("held"),
            F.when(bought, mean).when(held == 0, F.lit(0).cast("long")).otherwise(s["cost"]).alias("cost"),
            (s["pnl"] + F.when(sold, nearest((x["price"] - s["cost"]) * x["qty"], 100)).otherwise(F.lit(0).cast("long"))).alias("pnl"),
            (s["filled"] + F.when(bought | sold, 1).otherwise(0)).alias("filled"),
            (s["refused"] + F.when(bought | sold, 0).otherwise(1)).alias("refused"),
        )

    end = F.aggregate("xs", zero, step)
    return t.select(key, end.alias("s")).select(key, *[F.col(f"s.{c}") for c in ("cash", "held", "cost", "pnl", "filled", "refused")])
