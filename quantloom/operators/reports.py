"""Yearly tables and dashboards of companies: trends, owner inputs, holding structure, enterprise value with floor prices,
price ranges, dividends, holders, and lookups by source priority. All by company in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest

_c = F.col
# Least threshold and spread over the riskless rate by market, and the bands of the premium over the floor price, in percent.
THRESHOLDS = {"HK": (5.0, 3.0), "US": (4.0, 2.0), "CN": (3.5, 2.0)}
BANDS = [(0, "below_floor"), (30, "near"), (80, "fair"), (150, "high")]


def threshold(rf: Column, market: Column) -> Column:
    """The greater of a market's least return and the riskless rate with its spread; null without a rate."""
    cases = [F.when(market == m, F.greatest(F.lit(low), rf + spread)) for m, (low, spread) in THRESHOLDS.items()]
    return F.when(rf.isNotNull(), F.coalesce(*cases, F.greatest(F.lit(THRESHOLDS["CN"][0]), rf + THRESHOLDS["CN"][1])))


def verdict(premium: Column) -> Column:
    out = F.when(premium <= BANDS[0][0], BANDS[0][1])
    for most, name in BANDS[1:]:
        out = out.when(premium <= most, name)
    return F.when(premium.isNotNull(), out.otherwise("extreme"))


def total_of(*parts: Column) -> Column:
    """The sum of the parts that are there; null if none is."""
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))


def _growth(x: str, key: str, year: str) -> Column:
    """Yearly growth in percent between a company's oldest and newest value above 0, over their number less one."""
    every, up = Window.partitionBy(key), F.when(_c(x) > 0, _c(x))
    at = lambda f: f(up, F.when(_c(x) > 0, _c(year))).over(every)
    n = F.count(up).over(every)
    return F.when(n > 1, (F.pow(at(F.max_by) / at(F.min_by), 1.0 / (n - 1)) - 1) * 100)


def trends(df: DataFrame, key: str = "code", year: str = "yr") -> DataFrame:
    """A row for each year of companies with two or more: debt by assets, net cash and payout beside revenue and profit, with their growth over all years."""
    t = df.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where("__n > 1")
    return t.select(
        key, year, "revenue", "profit", "debt", F.when(_c("assets") > 0, _c("debt") / _c("assets") * 100).alias("debt_ratio"), (_c("cash") - _c("debt")).alias("net_cash"), "payout",
        _growth("revenue", key, year).alias("revenue_cagr"), _growth("profit", key, year).alias("profit_cagr"),
    )


def owner_inputs(df: DataFrame, rf: float | None, market: str = "CN", key: str = "code", year: str = "yr") -> DataFrame:
    """Median of capital spending by depreciation, mean and deviation of three years' payout, minority share, free cash and base of owner earnings, with the threshold."""
    t = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(year))))
    now = lambda x: F.max(F.when(_c("__r") == 1, x))
    ratio = F.when((_c("da") > 0) & _c("capex").isNotNull(), F.abs("capex") / _c("da"))
    paid = F.when(_c("__r") <= 3, _c("payout"))
    t = t.groupBy(key).agg(
        now(_c("profit")).alias("c"), now(F.when(_c("n_income") != 0, _c("minority") / _c("n_income") * 100)).alias("minority_share"), now(_c("ocf") - F.abs("capex")).alias("fcf"),
        F.median(ratio).alias("f"), F.avg(paid).alias("m"), F.when(F.count(paid) > 1, F.stddev_samp(paid)).when(F.count(paid) == 1, 0.0).alias("n"),
    )
    return t.withColumn("ii", threshold(F.lit(rf).cast("double"), F.lit(market)))


def holding_structure(consolidated: DataFrame, parent: DataFrame, key: str = "code", year: str = "yr") -> DataFrame:
    """Debt, cash and net cash of the newest statements of group and parent, and the subsidiaries' share of debt in percent."""
    newest = lambda t, p: latest(t, [key], [F.desc(year)]).select(key, *[F.coalesce(_c(x), F.lit(0.0)).alias(f"{p}_{x}") for x in ("debt", "cash")])
    t = newest(consolidated, "group").join(newest(parent, "parent"), key)
    net = [(_c(f"{p}_cash") - _c(f"{p}_debt")).alias(f"{p}_net") for p in ("group", "parent")]
    return t.select("*", *net, F.when(_c("group_debt") > 0, (_c("group_debt") - _c("parent_debt")) / _c("group_debt") * 100).alias("subsidiary_share"))


def value_dashboard(years: DataFrame, basics: DataFrame, lows: DataFrame, rf: float | None, key: str = "code", year: str = "yr") -> DataFrame:
    """Enterprise value and its ratios, five floor prices with their mean, and the price's premium over it.

    ``years``: ``cash, tradable, debt, equity, assets, goodwill, operating, finance_exp, profit, da, ocf, capex, dps``; ``basics``: ``close,
    cap, shares``, all above 0; ``lows``: ``low``, the least close of ten years. Floors: net liquid assets and equity by
    share, the low, three years' dividends at the riskless rate (3 % at least), and the least free cash of all years,
    if all are above 0, at the riskless rate. Missing amounts count as 0 but for the last two.
    """
    z = lambda x: F.coalesce(_c(x), F.lit(0.0))
    t = years.withColumns({"__r": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(year))), "__d": F.row_number().over(Window.partitionBy(key).orderBy(_c("dps").isNull(), F.desc(year)))})
    now = lambda x: F.max(F.when(_c("__r") == 1, x))
    free = _c("ocf") - _c("capex")
    names = ["cash", "tradable", "debt", "equity", "assets", "goodwill", "operating", "finance_exp", "profit", "da"]
    t = t.groupBy(key).agg(
        *[now(z(x)).alias(x) for x in names], now(z("ocf") - z("capex")).alias("fcf"), F.min(free).alias("least_fcf"),
        F.avg(F.when(_c("__d") <= 3, _c("dps"))).alias("mean_dps"), F.max(F.when(_c("__d") == 1, _c("dps"))).alias("dps"),
    )
    t = t.join(basics.where("close > 0 and cap > 0 and shares > 0").select(key, "close", "cap", "shares"), key).join(lows.select(key, "low"), key, "left")
    t = t.withColumns({"ebitda": _c("operating") + _c("finance_exp") + _c("da"), "net_debt": _c("debt") - _c("cash")}).withColumn("ev", _c("cap") + _c("net_debt"))
    per = lambda a, b, k=1.0: F.when(b > 0, a / b * k)
    rate = F.lit(rf).cast("double")
    floors = {
        "floor_liquid": (_c("cash") + _c("tradable") - _c("debt")) / _c("shares"), "floor_equity": _c("equity") / _c("shares"), "floor_low": _c("low"),
        "floor_dividend": _c("mean_dps") / F.greatest(rate / 100, F.lit(0.03)), "floor_cash": F.when((rate > 0) & (_c("least_fcf") > 0), _c("least_fcf") / (rate / 100) / _c("shares")),
    }
    floors["floor_dividend"] = F.when(rate.isNotNull(), floors["floor_dividend"])
    t = t.withColumns(floors)
    there = F.filter(F.array(*map(_c, floors)), lambda x: x.isNotNull())
    t = t.withColumns({"n_floors": F.size(there), "floor": F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there)})
    t = t.withColumn("premium", F.try_divide(_c("close"), _c("floor")) * 100 - 100)
    return t.select(
        key, "ev", "ebitda", per(_c("ev"), _c("ebitda")).alias("ev_ebitda"), per(_c("cap") + _c("net_debt"), _c("profit")).alias("cash_pe"), per(_c("fcf"), _c("cap"), 100.0).alias("fcf_yield"),
        per(_c("cap"), _c("equity")).alias("pb"), per(_c("net_debt"), _c("ebitda")).alias("net_debt_ebitda"), per(_c("goodwill"), _c("assets"), 100.0).alias("goodwill_ratio"),
        per(_c("debt"), _c("assets"), 100.0).alias("debt_ratio"), (_c("dps") / _c("close") * 100).alias("dividend_yield"), *floors, "n_floors", "floor", "premium", verdict(_c("premium")).alias("verdict"),
    )


def year_range(bars: DataFrame, days: int = 365) -> DataFrame:
    """High and low of a symbol's last ``days`` up to its newest bar, with their newest dates, last close, rise from the low in percent, mean volume."""
    newest = F.max("trade_date").over(Window.partitionBy("symbol"))
    t = bars.withColumn("__last", newest).where(F.col("trade_date") >= F.date_sub("__last", days)).groupBy("symbol")
    t = t.agg(
        F.max("high").alias("high"), F.max_by("trade_date", F.struct("high", "trade_date")).alias("high_date"), F.min("low").alias("low"),
        F.min_by("trade_date", F.struct("low", F.datediff(F.lit("2999-01-01"), "trade_date"))).alias("low_date"), F.max_by("close", "trade_date").alias("close"), F.avg("volume").alias("mean_volume"),
    )
    return t.withColumn("rise", (F.try_divide(_c("close"), _c("low")) - 1) * 100)


def ten_years(bars: DataFrame) -> DataFrame:
    """A row for each year of a symbol: high, low, last close, mean volume; with the whole span's high and low, their first dates, fall from the high and rise from the low in percent."""
    t = bars.groupBy("symbol", F.year("trade_date").alias("year")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"), F.avg("volume").alias("mean_volume"), F.max("trade_date").alias("__d"),
        F.max(F.struct(_c("high").alias("x"), (-F.unix_date("trade_date")).alias("d"))).alias("__hi"), F.min(F.struct(_c("low").alias("x"), F.unix_date("trade_date").alias("d"))).alias("__lo"),
    )
    every = Window.partitionBy("symbol")
    t = t.withColumns({"__top": F.max("__hi").over(every), "__bottom": F.min("__lo").over(every), "__last": F.max_by("close", "__d").over(every)})
    day = lambda n: F.date_add(F.lit("1970-01-01").cast("date"), n)
    return t.select(
        "symbol", "year", "high", "low", "close", "mean_volume", _c("__top.x").alias("span_high"), day(-_c("__top.d")).alias("high_date"), _c("__bottom.x").alias("span_low"), day(_c("__bottom.d")).alias("low_date"),
        ((1 - F.try_divide(_c("__last"), _c("__top.x"))) * 100).alias("fall"), ((F.try_divide(_c("__last"), _c("__bottom.x")) - 1) * 100).alias("rise"),
    )


def paid_dividends(df: DataFrame, order: list[Column], years: int = 5, key: str = "code") -> DataFrame:
    """Executed dividends (``status`` done), one for each ``end_date`` (the first by ``order``), of a company's ``years`` newest years."""
    t = latest(df.where("status = 'done'"), [key, "end_date"], order)
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.year("end_date").desc()))
    return t.withColumn("__r", rank).where(F.col("__r") <= years).drop("__r")


def newest_holders(df: DataFrame, period: str, order: list[Column], n: int = 10, key: str = "code") -> DataFrame:
    """The first ``n`` holders of each company's newest period."""
    t = df.withColumn("__p", F.max(period).over(Window.partitionBy(key))).where(F.col(period) == F.col("__p")).drop("__p")
    return t.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def first_with_data(df: DataFrame, period: str, candidates: list[str], value: str) -> DataFrame:
    """The rows of the first of the ``candidates`` for which any row has a value."""
    order = F.array_position(F.array(*map(F.lit, candidates)), F.col(period))
    t = df.where(F.col(period).isin(candidates) & F.col(value).isNotNull()).withColumn("__o", order)
    first = t.agg(F.min("__o").alias("__first"))
    return t.join(F.broadcast(first), F.col("__o") == F.col("__first")).drop("__o", "__first")  # one row


def by_source_priority(df: DataFrame, priority: list[str], key: str = "symbol", source: str = "data_source") -> DataFrame:
    """All rows of the first source in ``priority`` that has any row of a key; keys whose sources aren't listed give none."""
    order = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    t = df.where(F.col(source).isin(priority)).withColumn("__o", order)
    return t.withColumn("__best", F.min("__o").over(Window.partitionBy(key))).where("__o = __best").drop("__o", "__best")


def enabled_sources(config: DataFrame) -> list[str]:
    """Names of a small table ``name, priority, enabled``, those enabled, by falling priority and name."""
    return [r.name for r in config.where("enabled").orderBy(F.desc_nulls_last("priority"), "name").limit(100).collect()]
