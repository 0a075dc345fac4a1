"""Latest-per-key views, keyed merges and grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.sources.shared import staged


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (a total order makes it unique). Plans a group limit before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last writer wins by ``version``; of equal versions the new row."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, keys, [F.desc(version), F.desc("__new")]).drop("__new")


def coalesce_sources(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Each key from the first frame that has it."""
    out = None
    for k, df in enumerate(frames):
        t = df.withColumn("__priority", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return latest(out, keys, [F.asc("__priority")]).drop("__priority")


def pick(df: DataFrame, mapping: dict[str, list[str] | str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Columns renamed from candidate lists; the first candidates that exist are coalesced, else null."""
    out = []
    for name, candidates in mapping.items():
        there = [F.col(c) for c in ([candidates] if isinstance(candidates, str) else candidates) if c in df.columns]
        column = F.coalesce(*there) if there else F.lit(None).cast((kinds or {}).get(name, "double"))
        out.append(column.alias(name))
    return df.select(*out)


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by the values of each column in one pass: ``dimension, value, n``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def set_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key`` and ``status``: added, removed or kept."""
    a = before.select(key).distinct().withColumn("__a", F.lit(True))
    b = after.select(key).distinct().withColumn("__b", F.lit(True))
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("kept")
    return a.join(b, key, "full").select(key, status.alias("status"))


#: Slices of the values that running counts are worked out in.
SLICES = 64


def order_statistics(df: DataFrame, key: str, x: str, percents: dict[str, float]) -> DataFrame:
    """``key`` and, by name, sorted[int(p / 100 * (n - 1))] of the key's values that aren't null, without interpolation.

    Equal values are counted first. A sketch of each key gives cuts for SLICES slices of its values; sums of the slices
    (SLICES rows a key) tell in which slice each wanted place lies, and only these slices' counts are added up, each on its
    own. So no task or array holds a key's values, however many rows the key has. Keys without a value and the null key give no row.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(x).alias("__v")).agg(F.count("*").alias("__n"))
    counts = staged(counts, "order-counts")
    # The cuts only steer the slices' sizes.
    cuts = counts.groupBy("__k").agg(F.percentile_approx("__v", [k / SLICES for k in range(1, SLICES)], 1000).alias("__cuts"), F.sum("__n").alias("__all"))
    counts = counts.join(cuts, "__k").withColumn("__slice", F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))).drop("__cuts")
    totals = counts.groupBy("__k", "__slice").agg(F.sum("__n").alias("__in"), F.first("__all").alias("__all"))
    below = F.sum("__in").over(Window.partitionBy("__k").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("__below", F.coalesce(below, F.lit(0)))
    places = F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.lit(p / 100) * (F.col("__all") - 1)).alias("at")) for name, p in percents.items()])
    wanted = totals.withColumn("__w", F.explode(places)).where((F.col("__w.at") >= F.col("__below")) & (F.col("__w.at") < F.col("__below") + F.col("__in")))
    wanted = wanted.groupBy("__k", "__slice").agg(F.collect_list(F.struct("__w.name", (F.col("__w.at") - F.col("__below")).alias("at"))).alias("__w"))
    up_to = F.sum("__n").over(Window.partitionBy("__k", "__slice").orderBy("__v"))
    inside = counts.join(wanted, ["__k", "__slice"]).withColumn("__up", up_to)
    found = inside.select("__k", "__v", "__n", "__up", F.explode("__w").alias("w")).where((F.col("w.at") < F.col("__up")) & (F.col("w.at") >= F.col("__up") - F.col("__n")))
    return found.groupBy(F.col("__k").alias(key)).agg(*[F.max(F.when(F.col("w.name") == name, F.col("__v"))).alias(name) for name in percents])


def global_ranks(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with, for each numeric column ``x``: ``__x_before`` (rows of lesser value), ``__x_ties`` (rows of its value), and
    ``__x_nulls`` and ``__rows`` (rows in all). Values are counted first; their running counts are prefix sums of SLICES slices' totals
    and of the values inside a slice, so no task sees them all. NaN counts as the greatest value."""
    base = df = staged(df, "ranked")
    cuts = base.approxQuantile(list(columns), [k / SLICES for k in range(1, SLICES)], 1 / (4 * SLICES))
    for x, found in zip(columns, cuts):
        counts = base.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("__v")).agg(F.count("*").alias(f"__{x}_ties"))
        edges = sorted(set(found))
        at = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e <= F.col("__v"))) if edges else F.lit(0)
        counts = counts.withColumn("__slice", at)
        totals = counts.groupBy("__slice").agg(F.sum(f"__{x}_ties").alias("__n"))  # SLICES rows at most
        below = F.sum("__n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
        totals = totals.select("__slice", F.coalesce(below, F.lit(0)).alias("__below"))
        inside = F.sum(f"__{x}_ties").over(Window.partitionBy("__slice").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1))
        before = F.col("__below") + F.coalesce(inside, F.lit(0))
        ranks = counts.join(F.broadcast(totals), "__slice").select("__v", f"__{x}_ties", before.alias(f"__{x}_before"))
        df = df.join(ranks, F.col(x) == F.col("__v"), "left").drop("__v")
    rows = base.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(x).isNull()).alias(f"__{x}_nulls") for x in columns])
    return df.join(F.broadcast(rows), F.lit(True))  # one row


def percentile(df: DataFrame, x: str, nulls_last: bool) -> Column:
    """Average-tie percentile rank of a column that ``global_ranks`` was given; nulls rank as equals, last or first."""
    n = F.col(f"__{x}_nulls")
    first = F.when(F.col(x).isNull(), (F.col("__rows") - n if nulls_last else F.lit(0)) + 1).otherwise(F.col(f"__{x}_before") + (F.lit(0) if nulls_last else n) + 1)
    ties = F.when(F.col(x).isNull(), n).otherwise(F.col(f"__{x}_ties"))
    return (first + (ties - 1) / 2) / F.col("__rows")
