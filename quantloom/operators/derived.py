"""Further derived metrics: payout, owner earnings, grids, market units, sentiment blends and statement displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import global_ranks

_c = F.col

# Units of market value by market, and dividend tax by holding in percent.
CAP_UNIT = {"CN": 1e4, "HK": 1e6, "US": 1.0}
DIVIDEND_TAX = [("CN", "over_1y", 0.0), ("CN", "1m_1y", 10.0), ("CN", "under_1m", 20.0), ("HK", "connect", 20.0), ("US", "treaty", 10.0)]


def market_cap(cap: Column, market: Column) -> Column:
    """In units of the currency."""
    return cap * F.coalesce(*[F.when(market == k, F.lit(v)) for k, v in CAP_UNIT.items()])


def payout(dividend: Column, profit: Column) -> Column:
    return F.when(profit > 0, F.try_divide(dividend, profit) * 100)


def checked_payout(vendor: Column, own: Column) -> Column:
    """A ratio below 1 is a share and becomes percent; the vendor's counts if it lies within 20 % of one's own."""
    v = F.when(vendor < 1, vendor * 100).otherwise(vendor)
    return F.when(F.abs(v - own) <= 0.2 * F.abs(own), v).otherwise(F.coalesce(own, v))


def owner_cash(ocf: Column, capex: Column) -> Column:
    return ocf - F.abs(capex)


def outflow(w1: Column, staff: Column, overheads: Column, w3: Column, w4: Column) -> Column:
    """Suppliers, staff (overheads where staff pay is missing or 0), taxes and interest."""
    w2 = F.when(F.coalesce(staff, F.lit(0.0)) != 0, staff).otherwise(F.coalesce(overheads, F.lit(0.0)))
    return w1 + w2 + F.coalesce(w3, F.lit(0.0)) + F.coalesce(w4, F.lit(0.0))


def ev_to_ebitda(cap: Column, debt: Column, cash: Column, ebitda: Column) -> Column:
    return F.when(ebitda > 0, F.try_divide(cap + F.coalesce(debt, F.lit(0.0)) - F.coalesce(cash, F.lit(0.0)), ebitda))


def premium_band(premium: Column) -> Column:
    return F.when(premium < 0, "below_floor").when(premium < 30, "near").when(premium < 80, "fair").when(premium < 150, "high").otherwise("extreme")


def grid(df: DataFrame, value: object, **axes: list[float]) -> DataFrame:
    """A row for each combination of the axes' literals; their number doesn't depend on the data."""
    out = df
    for name, xs in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(x) for x in xs])))
    return out.withColumn("value", value(*[_c(a) for a in axes]))


def combined_score(rule: Column, semantic: Column, classifier: Column) -> Column:
    """0.40, 0.35 and 0.25; a score that isn't there counts as 0."""
    part = lambda x, w: F.coalesce(x, F.lit(0.0)) * w
    return part(rule, 0.40) + part(semantic, 0.35) + part(classifier, 0.25)


def overall_sentiment(parts: list[tuple[Column, Column]]) -> Column:
    """Confidence-weighted mean; 0 where no source has any confidence."""
    total = sum((F.coalesce(s * c, F.lit(0.0)) for s, c in parts), F.lit(0.0))
    weight = sum((F.coalesce(c, F.lit(0.0)) for _, c in parts), F.lit(0.0))
    return F.coalesce(F.try_divide(total, F.when(weight > 0, weight)), F.lit(0.0))


def sentiment_level(s: Column) -> Column:
    return F.when(s > 0.3, "very_positive").when(s > 0.1, "positive").when(s > -0.1, "neutral").when(s > -0.3, "negative").otherwise("very_negative")


def best_cosine(v: Column, phrases: list[list[float]]) -> Column:
    """The greatest cosine to any phrase, times 100; null for a zero vector."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    out = []
    for p in phrases:
        q = F.array(*[F.lit(float(x)) for x in p])
        norm = sum(x * x for x in p) ** 0.5
        out.append(F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.lit(norm)))
    return F.greatest(*out) * 100 if len(out) > 1 else out[0] * 100


def appended(old: DataFrame, new: DataFrame, key: str, group: str, order: list[Column]) -> DataFrame:
    """``new`` below ``old`` with ids that go on from its greatest, by ``group`` (a number without nulls) and, inside a group, ``order``."""
    last = old.agg(F.coalesce(F.max(key), F.lit(-1)).alias("__last"))
    placed = global_ranks(new, group)
    place = _c(f"__{group}_before") + F.row_number().over(Window.partitionBy(group).orderBy(*order))
    numbered = placed.withColumn("__k", place).join(F.broadcast(last), F.lit(True))  # one row
    return old.unionByName(numbered.withColumn(key, (_c("__last") + _c("__k")).cast("long")).select(*old.columns))


def display_periods(df: DataFrame, key: str, year: str, quarter: str, n: int = 5) -> DataFrame:
    """The last ``n`` full years and the quarters after the newest of them, labelled 2024, 2024Q1, 2024H1 or 2024Q3."""
    newest = Window.partitionBy(key)
    t = df.withColumn("__last", F.max(F.when(_c(quarter) == 4, _c(year))).over(newest))
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.when(_c(quarter) == 4, _c(year)).desc_nulls_last()))
    t = t.withColumn("__r", rank)
    keep = ((_c(quarter) == 4) & (_c("__r") <= n)) | ((_c(quarter) != 4) & (_c(year) > F.coalesce("__last", F.lit(0))))
    label = F.concat(_c(year).cast("string"), F.when(_c(quarter) == 4, "").when(_c(quarter) == 2, "H1").otherwise(F.concat(F.lit("Q"), _c(quarter).cast("string"))))
    return t.where(keep).withColumn("label", label).drop("__last", "__r")


def consistency(diff: Column, tolerance: float) -> Column:
    """1 at no difference, 0 from the tolerance on."""
    return F.greatest(F.lit(0.0), 1 - diff / tolerance)


def action_band(score: Column) -> Column:
    return F.when(score >= 0.8, "use_primary").when(score >= 0.6, "use_with_warning").when(score >= 0.3, "check").otherwise("investigate")
