"""The factor registry: 30 alpha factors over a long panel, each a function of a panel that returns it with ``value``.

A factor whose fields are missing gives nulls. Inputs are staged as columns where one window needs another's result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import recursions
from quantloom.functions import windows as w
from quantloom.operators import panel as p


@dataclass(frozen=True)
class Factor:
    name: str
    requires: tuple[str, ...]
    make: Callable[[DataFrame], DataFrame]


REGISTRY: dict[str, Factor] = {}


def factor(name: str, *requires: str) -> Callable:
    def add(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        REGISTRY[name] = Factor(name, requires or ("close",), make)
        return make

    return add


def list_factors() -> list[str]:
    return sorted(REGISTRY)


def compute_factor(panel: DataFrame, name: str) -> DataFrame:
    """``symbol, trade_date, value``."""
    f = REGISTRY[name]
    if not set(f.requires) <= set(panel.columns):
        return panel.select("symbol", "trade_date", F.lit(None).cast("double").alias("value"))
    return f.make(panel).select("symbol", "trade_date", "value")


def compute_factor_panel(panel: DataFrame, names: list[str]) -> DataFrame:
    """One column for each factor. All share the sort by symbol and date."""
    out, extra = panel, []
    for name in names:
        f = REGISTRY[name]
        if set(f.requires) <= set(panel.columns):
            before = set(out.columns)
            out = f.make(out).withColumnRenamed("value", name)
            out = out.drop(*[c for c in out.columns if c not in before and c != name])
        else:
            out = out.withColumn(name, F.lit(None).cast("double"))
        extra.append(name)
    return out.select("symbol", "trade_date", *extra)


def _c(name: str = "close") -> Column:
    return F.col(name)


def _return(df: DataFrame) -> DataFrame:
    """``ret``: change against the last close that isn't null."""
    filled = F.last("close", ignorenulls=True).over(w.so_far())
    df = df.withColumn("filled", filled)
    return df.withColumn("ret", F.try_divide(_c("filled"), w.lag(_c("filled"), 1)) - 1)


def _momentum(n: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("value", w.safe_div(_c(), w.lag(_c(), n)) - 1)


factor("MOM_20")(_momentum(20))
factor("ROC_10")(_momentum(10))


@factor("RSI_14")
def rsi_14(df: DataFrame) -> DataFrame:
    """Weights (13/14)^age on gains and losses; their sums' share. A missing change counts as none."""
    df = df.withColumn("change", _c() - w.lag(_c(), 1))
    # greatest() skips nulls, so that a missing change gives 0 and still ages the sums.
    df = df.withColumns({"gain": F.greatest(_c("change"), F.lit(0.0)), "loss": F.greatest(-_c("change"), F.lit(0.0)), "enough": F.count("change").over(w.so_far()) >= 14})
    keep = 13 / 14
    df = recursions.scan(df, {f"{x}_sum": recursions.Recursion(x, recursions.decayed(keep), keep, initial=0.0) for x in ("gain", "loss")})
    return df.withColumn("value", F.when(_c("enough"), 100 * F.try_divide(_c("gain_sum"), _c("gain_sum") + _c("loss_sum"))))


@factor("ALPHA_001")
def alpha_001(df: DataFrame) -> DataFrame:
    df = _return(df).withColumn("sd", w.std(_c("ret"), 20))
    down = (F.col("ret") < 0).cast("double")
    blend = down * _c("sd") + (1 - down) * _c()
    df = df.withColumn("signal", p.signed_power(blend, 2.0)).withColumn("place", p.ts_argmax(_c("signal"), 5))
    return df.withColumn("value", p.cs_rank(_c("place")) - 0.5)


@factor("TS_RANK_20")
def ts_rank_20(df: DataFrame) -> DataFrame:
    return df.withColumn("value", p.ts_rank(_c(), 20))


@factor("MOM_ACCEL")
def mom_accel(df: DataFrame) -> DataFrame:
    df = _momentum(20)(df).withColumnRenamed("value", "mom")
    return df.withColumn("value", _c("mom") - w.lag(_c("mom"), 5))


@factor("MA_CROSS_20_60")
def ma_cross(df: DataFrame) -> DataFrame:
    return df.withColumn("value", w.safe_div(w.mean(_c(), 20), w.mean(_c(), 60)) - 1)


@factor("MAX_20_RET")
def max_20_ret(df: DataFrame) -> DataFrame:
    return df.withColumn("value", w.safe_div(_c(), w.highest(_c(), 20)) - 1)


@factor("BIAS_20")
def bias_20(df: DataFrame) -> DataFrame:
    return df.withColumn("value", w.safe_div(_c(), w.mean(_c(), 20)) - 1)


@factor("BOLL_DIST")
def boll_dist(df: DataFrame) -> DataFrame:
    return df.withColumn("value", w.safe_div(_c() - w.mean(_c(), 20), 4 * w.std(_c(), 20)))


@factor("REV_TS_RANK_20")
def rev_ts_rank_20(df: DataFrame) -> DataFrame:
    return df.withColumn("value", 0.5 - p.ts_rank(_c(), 20))


@factor("RSV_20", "close", "high", "low")
def rsv_20(df: DataFrame) -> DataFrame:
    low, high = w.lowest(_c("low"), 20), w.highest(_c("high"), 20)
    return df.withColumn("value", w.safe_div(_c() - low, high - low))


@factor("PSY_20")
def psy_20(df: DataFrame) -> DataFrame:
    df = df.withColumn("up", F.coalesce((_c() > w.lag(_c(), 1)).cast("double"), F.lit(0.0)))
    return df.withColumn("value", w.mean(_c("up"), 20))


@factor("VOL_20")
def vol_20(df: DataFrame) -> DataFrame:
    return _return(df).withColumn("value", w.std(_c("ret"), 20))


@factor("ATR_14", "close", "high", "low")
def atr_14(df: DataFrame) -> DataFrame:
    df = df.withColumn("before", w.lag(_c(), 1))
    a, b, c = _c("high") - _c("low"), F.abs(_c("high") - _c("before")), F.abs(_c("low") - _c("before"))
    df = df.withColumn("tr", F.when(a >= b, a).otherwise(b))
    df = df.withColumn("tr", F.when(_c("tr") >= c, _c("tr")).otherwise(c))
    return df.withColumn("value", w.safe_div(w.mean(_c("tr"), 14), _c()))


@factor("VOL_CHG_5")
def vol_chg_5(df: DataFrame) -> DataFrame:
    df = _return(df).withColumn("sd", w.std(_c("ret"), 20))
    return df.withColumn("value", _c("sd") - w.lag(_c("sd"), 5))


@factor("VOL_RATIO")
def vol_ratio(df: DataFrame) -> DataFrame:
    return _return(df).withColumn("value", w.safe_div(w.std(_c("ret"), 5), w.std(_c("ret"), 20)))


@factor("RANGE_20", "close", "high", "low")
def range_20(df: DataFrame) -> DataFrame:
    return df.withColumn("value", w.safe_div(w.highest(_c("high"), 20) - w.lowest(_c("low"), 20), w.mean(_c(), 20)))


@factor("OBV_20", "close", "volume")
def obv_20(df: DataFrame) -> DataFrame:
    df = df.withColumn("signed", F.coalesce(F.signum(_c() - w.lag(_c(), 1)), F.lit(0.0)) * _c("volume"))
    df = df.withColumn("obv", F.sum("signed").over(w.so_far()))
    return df.withColumn("value", w.safe_div(_c("obv") - w.lag(_c("obv"), 20), w.mean(_c("volume"), 20)))


@factor("VR_20", "close", "volume")
def vr_20(df: DataFrame) -> DataFrame:
    change = _c() - w.lag(_c(), 1)
    df = df.withColumn("up", F.when(change > 0, _c("volume")).otherwise(0.0)).withColumn("down", F.when(change < 0, _c("volume")).otherwise(0.0))
    return df.withColumn("value", w.safe_div(w.total(_c("up"), 20), w.total(_c("down"), 20)))


@factor("VOL_RATIO_5", "close", "volume")
def vol_ratio_5(df: DataFrame) -> DataFrame:
    return df.withColumn("value", w.safe_div(_c("volume"), w.mean(_c("volume"), 5)))


@factor("CORR_20", "close", "volume")
def corr_20(df: DataFrame) -> DataFrame:
    return df.withColumn("value", p.ts_corr(_c(), F.log1p("volume"), 20))


@factor("VMA_20", "close", "volume")
def vma_20(df: DataFrame) -> DataFrame:
    return df.withColumn("value", w.safe_div(w.mean(_c("volume"), 20), _c("volume")))


@factor("VSUMP_10", "close", "volume")
def vsump_10(df: DataFrame) -> DataFrame:
    df = df.withColumn("change", _c("volume") - w.lag(_c("volume"), 1))
    return df.withColumn("value", w.safe_div(w.total(F.when(_c("change").isNotNull(), F.greatest(_c("change"), F.lit(0.0))), 10), w.total(F.abs("change"), 10)))


@factor("ROE_CHG_Q", "roe")
def roe_chg_q(df: DataFrame) -> DataFrame:
    return df.withColumn("value", _c("roe") - w.lag(_c("roe"), 1))


@factor("PE_PCT_250", "pe_ttm")
def pe_pct_250(df: DataFrame) -> DataFrame:
    return df.withColumn("value", p.ts_rank(_c("pe_ttm"), 250))


@factor("EP_TTM", "pe_ttm")
def ep_ttm(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(_c("pe_ttm") > 0, 1 / _c("pe_ttm")))


@factor("BP", "pb")
def bp(df: DataFrame) -> DataFrame:
    return df.withColumn("value", w.safe_div(F.lit(1.0), _c("pb")))


@factor("PEG", "pe_ttm", "profit_yoy")
def peg(df: DataFrame) -> DataFrame:
    return df.withColumn("value", w.safe_div(_c("pe_ttm"), _c("profit_yoy")))


@factor("DV_TTM", "dv_ttm")
def dv_ttm(df: DataFrame) -> DataFrame:
    return df.withColumn("value", _c("dv_ttm").cast("double"))
