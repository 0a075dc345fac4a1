"""Disposable surplus, payout reconciliation and the grid of penetrating returns, one row a company and year in.

A company's years are few, so its ranks, differences and folds are windows and arrays of that size; every function plans
one shuffle by company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_c = F.col
PAIRS = [("m1", "m2"), ("m1", "m3"), ("m2", "m3")]


def surplus(df: DataFrame, key: str = "code", year: str = "yr") -> DataFrame:
    """Base surplus (``tcr`` less ``w`` less ``capex``) of each company: means, elasticity to revenue and how far to trust it.

    A year counts where ``tcr`` and ``w`` are there; a missing ``capex`` or ``revenue`` is 0. ``aa_all``: all years,
    ``aa_2y``: the last two, ``aa_excl``: those not below 0 (all if there are none), ``aa``: of two years, if there are two.
    ``lambda``: median of the last three changes of surplus per change of revenue between neighbouring years that count.
    ``cv``: of all revenues above 0, two at least. Companies without a year that counts give no row.
    """
    counts = _c("tcr").isNotNull() & _c("w").isNotNull()
    revenue = F.coalesce("revenue", F.lit(0.0))
    t = df.withColumn("__base", F.when(counts, _c("tcr") - _c("w") - F.coalesce("capex", F.lit(0.0))))
    by_year = Window.partitionBy(key).orderBy(year)
    before, onward = by_year.rowsBetween(Window.unboundedPreceding, -1), by_year.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("__last", F.last(F.when(counts, F.struct(_c("__base").alias("b"), revenue.alias("r"))), ignorenulls=True).over(before))
    t = t.withColumn("__ratio", F.when(counts, F.try_divide(_c("__base") - _c("__last.b"), revenue - _c("__last.r"))))
    t = t.withColumns({"__year": F.count("__base").over(onward), "__pair": F.count("__ratio").over(onward)})
    used = F.when(_c("__pair") <= 3, _c("__ratio"))
    sold, sold_here = F.when(_c("revenue") > 0, _c("revenue")), F.when(counts & (_c("revenue") > 0), _c("revenue"))
    t = t.groupBy(key).agg(
        F.count("__base").alias("years"), F.avg("__base").alias("aa_all"), F.avg(F.when(_c("__year") <= 2, _c("__base"))).alias("aa_2y"),
        F.avg(F.when(_c("__base") >= 0, _c("__base"))).alias("__positive"), F.median(used).alias("lambda"), F.count(sold).alias("__sold"),
        F.try_divide(F.stddev_pop(sold), F.avg(sold)).alias("__cv"), F.try_divide(F.max(sold_here), F.min(sold_here)).alias("__span"),
        F.coalesce(F.min(used >= 0) != F.max(used >= 0), F.lit(False)).alias("mixed_signs"),
    ).where("years > 0")
    odd = F.coalesce((_c("lambda") > 3) | (_c("lambda") < 0), F.lit(False))
    t = t.withColumns({"low_amplitude": F.coalesce((_c("__sold") >= 3) & (_c("__span") - 1 < 0.10), F.lit(False)), "odd_lambda": odd})
    warnings = sum((_c(x).cast("int") for x in ("low_amplitude", "mixed_signs", "odd_lambda")), F.lit(0))
    return t.select(
        key, "years", "aa_all", "aa_2y", F.coalesce("__positive", "aa_all").alias("aa_excl"), F.when(_c("years") >= 2, _c("aa_2y")).otherwise(_c("aa_all")).alias("aa"),
        F.when(_c("__sold") >= 2, _c("__cv")).alias("cv"), "lambda", "low_amplitude", "mixed_signs", "odd_lambda",
        F.when(odd | (warnings >= 2), "several").when(warnings == 1, "one").otherwise("normal").alias("reliability"),
    )


def payout_crosscheck(df: DataFrame, key: str = "code", year: str = "yr") -> DataFrame:
    """Three estimates of the payout ratio in percent, each the mean of those of the last three years that have it, and the one to use.

    ``m1``: dividend by earnings per share (``dps``; companies without any use ``dps_hkd``, in another currency perhaps:
    ``currency_note``), ``m2``: cash distributed by profit, ``m3``: the series ``payout``. Divisors must be above 0. If
    two of them lie over 15 % of their mean apart, the second counts; likewise if all of three dividends or more are equal
    to six digits, which hints at filled-in data. Otherwise the third, else the second, else the first.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(year))
    local = F.count("dps").over(Window.partitionBy(key)) > 0
    per = lambda a, b: F.when(b > 0, a / b * 100)
    m1 = F.when(local, per(_c("dps"), _c("eps"))).when(_c("dps_hkd") != 0, per(_c("dps_hkd"), _c("eps")))
    t = df.withColumns({"__r": F.row_number().over(newest), "__local": local})
    t = t.withColumns({"__m1": F.when(_c("__r") <= 3, m1), "__m2": F.when(_c("__r") <= 3, per(_c("dist"), _c("profit"))), "__m3": F.when(_c("__r") <= 3, _c("payout"))})
    digits = F.round("dps", 6)
    t = t.groupBy(key).agg(
        F.avg("__m1").alias("m1"), F.avg("__m2").alias("m2"), F.avg("__m3").alias("m3"), F.max("__local").alias("__local"),
        ((F.count("dps") >= 3) & (F.min(digits) == F.max(digits))).alias("__same"), F.count_if(F.coalesce(_c("dps_hkd"), F.lit(0.0)) != 0).alias("__hk"),
    )
    devs = [F.coalesce(F.try_divide(F.abs(_c(a) - _c(b)), (F.abs(a) + F.abs(b)) / 2), F.lit(0.0)) for a, b in PAIRS]
    t = t.withColumn("max_dev", F.greatest(*devs))
    pair = F.coalesce(*[F.when((_c("max_dev") > 0) & (d == _c("max_dev")), f"{a}/{b}") for d, (a, b) in zip(devs, PAIRS)])
    same = F.coalesce(_c("__local") & _c("__same"), F.lit(False))
    rule = (
        F.when((_c("max_dev") > 0.15) & _c("m2").isNotNull(), "apart").when(same & _c("m2").isNotNull(), "filled_in")
        .when(_c("m3").isNotNull(), "agree").when(_c("m2").isNotNull(), "no_series").when(_c("m1").isNotNull(), "only_first")
    )
    t = t.withColumns({"pair": pair, "identical_dps": same, "rule": rule, "currency_note": ~_c("__local") & (_c("__hk") > 0)}).where("rule is not null")
    label = F.when(_c("rule").isin("apart", "filled_in", "no_series"), "m2").when(_c("rule") == "agree", "m3").otherwise("m1")
    t = t.withColumn("label", label)
    chosen = F.when(_c("label") == "m1", _c("m1")).when(_c("label") == "m2", _c("m2")).otherwise(_c("m3"))
    return t.select(key, "m1", "m2", "m3", "max_dev", "pair", "identical_dps", "currency_note", "rule", "label", chosen.alias("m"))


def apart(candidates: Column, tolerance: float) -> Column:
    """An array of (label, v) without nulls and without those nearer than ``tolerance`` to one kept before, in order."""

    def keep(kept: Column, x: Column) -> Column:
        near = F.exists(kept, lambda k: F.abs(x["v"] - k["v"]) < tolerance)
        return F.when(x["v"].isNull() | near, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(candidates, F.array().cast("array<struct<label:string,v:double>>"), keep)


def penetration_grid(df: DataFrame, rates: list[float], default: float, key: str = "code") -> DataFrame:
    """Returns after tax for every base, payout ratio and tax rate that differ enough, one row each.

    ``df`` has profit ``c``, value ``cap``, price ``close``, threshold ``ii`` (percent), ``m1`` to ``m3`` with the recommended
    ``label`` and ``aa_2y, aa_all, aa_excl``. Payout ratios, recommended first, are dropped within 0.5 points of one kept,
    bases within 10,000 of one. ``r``: on profit, ``gg``: on the base, ``hh``: their difference, ``excess``: over the
    threshold, ``target``: the price at which ``gg`` at the default rate meets the threshold.
    """
    item = lambda name, v: F.struct(F.lit(name).alias("label"), v.cast("double").alias("v"))
    ms = F.array(*[item(m, _c(m)) for m in ("m1", "m2", "m3")])
    first = F.concat(F.filter(ms, lambda m: m["label"] == _c("label")), F.filter(ms, lambda m: m["label"] != _c("label")))
    bases = F.array(*[item(a, _c(a)) for a in ("aa_2y", "aa_all", "aa_excl")])
    t = df.where((_c("cap") > 0) & _c("c").isNotNull() & _c("ii").isNotNull())
    t = t.withColumns({"__m": apart(first, 0.5), "__aa": apart(bases, 1e4)})
    t = t.withColumn("__a", F.explode("__aa")).withColumn("__p", F.explode("__m")).withColumn("q", F.explode(F.array(*map(F.lit, rates))))
    gain = lambda base, q: base * _c("__p.v") / 100 * (1 - q / 100) / _c("cap") * 100
    gg, r = gain(_c("__a.v"), _c("q")), gain(_c("c"), _c("q"))
    target = F.when(_c("ii") > 0, _c("close") * gain(_c("__a.v"), F.lit(default)) / _c("ii")).otherwise(0.0)
    return t.select(
        key, _c("__a.label").alias("base"), _c("__p.label").alias("ratio"), "q", _c("__p.v").alias("m"), r.alias("r"), gg.alias("gg"), (r - gg).alias("hh"),
        (gg - _c("ii")).alias("excess"), target.alias("target"), F.coalesce(_c("__p.label") == _c("label"), F.lit(False)).alias("recommended"),
    )
