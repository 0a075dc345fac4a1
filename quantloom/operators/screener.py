"""The screening pipeline as one plan: universe and valuation joined, a first tier by market data, a second by statements, and a ranking.

Statements come as one row for each ``code`` and ``yr`` with the columns of ``STATEMENT``; all companies are analysed at once.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_c = F.col

STATEMENT = (
    "revenue oper_profit np_parent fin_exp ocf capex da cash trad ibd goodwill equity total_assets gross_margin ebitda_v netdebt_v fcff_v".split()
)


@dataclass(frozen=True)
class ScreenConfig:
    """Thresholds, limits and weights; percentages as percent."""

    min_listing_years: int = 3
    min_market_cap: float = 5.0
    min_turnover: float = 0.1
    max_pb: float = 10.0
    max_pe: float = 50.0
    main_limit: int = 150
    obs_limit: int = 50
    dv_weight: float = 0.4
    pe_weight: float = 0.3
    pb_weight: float = 0.3
    max_pledge: float = 70.0
    min_roe: float = 8.0
    min_gross_margin: float = 15.0
    max_debt_ratio: float = 70.0
    min_roe_obs: float = 0.0
    min_fcf_margin_obs: float = 0.0
    min_fcf_years_obs: int = 2
    weight_roe: float = 0.20
    weight_fcf_yield: float = 0.20
    weight_r: float = 0.25
    weight_ev: float = 0.15
    weight_premium: float = 0.20

    @classmethod
    def from_dict(cls, d: dict) -> ScreenConfig:
        """Unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in d.items() if k in known})

    def validate(self) -> list[str]:
        """What is wrong with it."""
        total = self.weight_roe + self.weight_fcf_yield + self.weight_r + self.weight_ev + self.weight_premium
        checks = {
            f"the weights add up to {total:.3f}, not 1": abs(total - 1) <= 0.01,
            "min_listing_years is negative": self.min_listing_years >= 0,
            "min_market_cap is negative": self.min_market_cap >= 0,
            "main_limit is below 1": self.main_limit >= 1,
            "obs_limit is negative": self.obs_limit >= 0,
            "min_fcf_years_obs is not within 0 to 5": 0 <= self.min_fcf_years_obs <= 5,
        }
        return [text for text, ok in checks.items() if not ok]


def bulk(universe: DataFrame, valuation: DataFrame) -> DataFrame:
    """Companies that stand in both, by ``code``."""
    return universe.join(valuation, "code")


def first_tier(df: DataFrame, cfg: ScreenConfig, year: Column) -> DataFrame:
    """``df`` (``listed, total_mv, turnover, pb, pe_ttm, dv_ttm``) filtered, with ``channel``, and cut to the limits of both channels.

    Main: a PE up to the limit and a dividend, best by dividend yield, 1/PE and 1/PB, each over its greatest. Observation: no PE,
    greatest value first. Without any yield at all, none is asked for. Ties go by ``code``.
    """
    t = df.where(_c("listed").isNull() | (_c("listed") <= year - cfg.min_listing_years))
    t = t.where((_c("total_mv") >= cfg.min_market_cap) & (_c("turnover") >= cfg.min_turnover) & (_c("pb") > 0) & (_c("pb") <= cfg.max_pb))
    obs = t.where("pe_ttm is null").orderBy(F.desc("total_mv"), "code").limit(cfg.obs_limit)
    main = t.where((_c("pe_ttm") > 0) & (_c("pe_ttm") <= cfg.max_pe))
    paid = _c("dv_ttm") > 0
    best = lambda x: F.coalesce(F.max(F.when(paid, x)), F.max(x))
    tops = main.agg(F.count("dv_ttm").alias("__n"), F.max("dv_ttm").alias("__dv"), best(1 / _c("pe_ttm")).alias("__pe"), best(1 / _c("pb")).alias("__pb"))
    main = main.join(F.broadcast(tops), F.lit(True)).where(paid | (_c("__n") == 0))  # one row
    share = F.coalesce(F.when(_c("__dv") > 0, _c("dv_ttm") / _c("__dv")), F.lit(0.0))
    score = cfg.dv_weight * share + cfg.pe_weight * (1 / _c("pe_ttm") / _c("__pe")) + cfg.pb_weight * (1 / _c("pb") / _c("__pb"))
    main = main.withColumn("__s", score).orderBy(F.desc("__s"), "code").limit(cfg.main_limit).select(*df.columns)
    return main.withColumn("channel", F.lit("main")).unionByName(obs.withColumn("channel", F.lit("observation")))


def latest_statements(statements: DataFrame) -> DataFrame:
    """A row by ``code``: the newest year's figures and, over the last five, ``fcf_years``, ``fcf_good``, ``fcf_good_abs``, ``fcf_min``."""
    t = statements.withColumn("__r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("yr"))))
    five, free = _c("__r") <= 5, _c("ocf") - _c("capex")
    newest = [F.max(F.when(_c("__r") == 1, _c(x))).alias(x) for x in STATEMENT]
    return t.where(five).groupBy("code").agg(
        *newest,
        F.count(free).alias("fcf_years"),
        F.count_if(free > 0).alias("fcf_good"),
        F.count_if(_c("ocf") - F.abs("capex") > 0).alias("fcf_good_abs"),
        F.min(free).alias("fcf_min"),
    )


def valuation_metrics(t: DataFrame) -> DataFrame:
    """EV/EBITDA, debt, free cash and goodwill ratios beside the newest figures and ``total_mv``. The vendor's EBITDA, net debt and
    free cash flow come first; the margin is of one's own free cash flow (``ocf - capex``)."""
    zero = lambda x: F.coalesce(_c(x), F.lit(0.0))
    own = zero("ocf") - zero("capex")
    ebitda = F.coalesce("ebitda_v", _c("oper_profit") + zero("fin_exp") + zero("da"))
    debt = F.coalesce("netdebt_v", zero("ibd") - zero("cash"))
    positive = lambda x: F.when(x > 0, x)
    return t.withColumns({
        "ev_ebitda": (_c("total_mv") + debt) / positive(ebitda),
        "net_debt_ebitda": debt / positive(ebitda),
        "fcf_yield": F.coalesce("fcff_v", own) / positive(_c("total_mv")) * 100,
        "fcf_margin": own / positive(_c("revenue")) * 100,
        "fcf_consistency": _c("fcf_good") / positive(_c("fcf_years")),
        "goodwill_ratio": zero("goodwill") / positive(_c("total_assets")) * 100,
        "cash_adj_pe": (_c("total_mv") + debt) / positive(_c("np_parent")),
    })


def quality(cfg: ScreenConfig) -> Column:
    """Whether a company of either channel passes on ROE, margin and debt; missing ones pass. Observed ones need operating cash, a free
    cash margin and enough years of free cash flow besides."""
    roe, debt = _c("np_parent") / F.when(_c("equity") > 0, _c("equity")) * 100, _c("ibd") / F.when(_c("total_assets") > 0, _c("total_assets")) * 100
    passes = lambda e: F.coalesce(e, F.lit(True))
    least = F.when(_c("channel") == "main", cfg.min_roe).otherwise(cfg.min_roe_obs)
    common = passes(roe >= least) & passes(_c("gross_margin") >= cfg.min_gross_margin) & passes(debt <= cfg.max_debt_ratio)
    margin = (_c("ocf") - F.abs(F.coalesce("capex", F.lit(0.0)))) / F.when(_c("revenue") > 0, _c("revenue")) * 100
    observed = (_c("ocf") > 0) & (margin >= cfg.min_fcf_margin_obs) & (_c("fcf_good_abs") >= cfg.min_fcf_years_obs)
    return common & ((_c("channel") == "main") | F.coalesce(observed, F.lit(False)))


def floor_metrics(t: DataFrame, rf: float) -> DataFrame:
    """``floor`` (mean of net liquid assets, book value, ``low``, the dividend's and the worst free cash flow's worth, by share) and ``premium``."""
    shares = _c("total_mv") / F.when(_c("close") > 0, _c("close"))
    lines = [
        (F.coalesce("cash", F.lit(0.0)) + F.coalesce("trad", F.lit(0.0)) - F.coalesce("ibd", F.lit(0.0))) / shares,
        F.coalesce("equity", F.lit(0.0)) / shares,
        _c("low"),
        _c("dps3") / max(rf / 100, 0.03),
        F.when(_c("fcf_min") > 0, _c("fcf_min") / (rf / 100) / shares),
    ]
    xs = F.array_compact(F.array(*lines))
    t = t.withColumn("floor", F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs)))
    return t.withColumn("premium", (_c("close") / F.when(_c("floor") > 0, _c("floor")) - 1) * 100)


def percentile_rank(x: str, nulls_last: bool) -> Column:
    """Mean rank over the count. Only for tables that a limit has bounded: all rows meet in one task."""
    order = F.asc_nulls_last(x) if nulls_last else F.asc_nulls_first(x)
    ties = F.count("*").over(Window.partitionBy(x))
    return (F.rank().over(Window.orderBy(order)) + (ties - 1) / 2.0) / F.count("*").over(Window.partitionBy())


def second_tier(first: DataFrame, statements: DataFrame, vetoes: DataFrame, dividends: DataFrame, rf: float, cfg: ScreenConfig) -> DataFrame:
    """``first`` (of :func:`first_tier`: at most the sum of both limits) without vetoed and weak companies, with all measures and ``score``.

    ``vetoes``: ``code, pledge, clean`` (null: no veto); ``dividends``: ``code, dps3, low``. Only the kept companies' statements are aggregated.
    """
    first = F.broadcast(first)  # bounded by the limits
    mine = statements.join(first.select("code"), "code", "left_semi")
    t = first.join(latest_statements(mine), "code", "left")
    t = t.join(vetoes.join(first.select("code"), "code", "left_semi"), "code", "left").join(dividends.join(first.select("code"), "code", "left_semi"), "code", "left")
    t = t.where(F.coalesce(_c("pledge") <= cfg.max_pledge, F.lit(True)) & F.coalesce("clean", F.lit(True))).where(quality(cfg))
    roe = _c("np_parent") / F.when(_c("equity") > 0, _c("equity")) * 100
    payout = F.when(_c("np_parent") > 0, _c("dps3") * (_c("total_mv") / F.when(_c("close") > 0, _c("close"))) / _c("np_parent"))
    cash = F.coalesce("ocf", F.lit(0.0)) - F.abs(F.coalesce("capex", F.lit(0.0)))
    t = floor_metrics(valuation_metrics(t), rf).withColumns({"roe": roe, "r": cash * F.least(payout, F.lit(1.0)) / F.when(_c("total_mv") > 0, _c("total_mv")) * 100})
    up = [("roe", cfg.weight_roe), ("fcf_yield", cfg.weight_fcf_yield), ("r", cfg.weight_r)]
    down = [("ev_ebitda", cfg.weight_ev), ("premium", cfg.weight_premium)]
    score = sum((w * percentile_rank(x, True) for x, w in up), F.lit(0.0)) + sum((w * (1 - percentile_rank(x, False)) for x, w in down), F.lit(0.0))
    return t.withColumn("score", score)


def annual_dps(dividends: DataFrame, paid: DataFrame) -> DataFrame:
    """``code, yr, dps``: a year's dividends by share, or what was paid out by share if the dividends make up less than half of that.

    ``dividends``: ``code, yr, dps``; ``paid``: ``code, yr, paid, shares``. Years without a dividend go.
    """
    t = dividends.groupBy("code", "yr").agg(F.sum("dps").alias("dps")).join(paid, ["code", "yr"], "left")
    share = _c("dps") * _c("shares") / F.when(_c("paid") > 0, _c("paid"))
    fixed = F.when((share > 0) & (share < 0.5), _c("paid") / _c("shares")).otherwise(_c("dps"))
    return t.select("code", "yr", fixed.alias("dps")).where("dps > 0")


def dividend_model(ke: float, terminal: float) -> dict[str, Column]:
    """``model`` and ``value`` out of ``n, dps, cagr`` (percent), ``payout_avg, payout_sd`` and ``roe``; rates in percent.

    Gordon's if dividends grow by less than 5 % and the payout's variation is below 0.2 and its growth, the lesser of the past one and
    ROE (1 - payout), is below ``ke``; else two stages of five years and for good. Null below three years.
    """
    cv = F.coalesce(F.coalesce("payout_sd", F.lit(0.0)) / F.when(_c("payout_avg") > 0, _c("payout_avg")), F.lit(0.0))
    g1 = F.coalesce("cagr", F.lit(2.0))
    kept = F.when((_c("roe") != 0) & (_c("payout_avg") != 0), _c("roe") * (1 - _c("payout_avg") / 100))
    g = F.least(g1, F.coalesce(kept, g1))
    gordon = (g1 < 5) & (cv < 0.2) & (g < ke)
    one = _c("dps") * (1 + g / 100) / (F.lit(ke) / 100 - g / 100)
    g2 = min(terminal, ke - 1.0)
    step, rate = 1 + g1 / 100, 1 + ke / 100
    years = [(_c("dps") * F.pow(step, F.lit(i)) / rate**i) for i in range(1, 6)]
    two = sum(years[1:], years[0]) + _c("dps") * F.pow(step, F.lit(5)) * (1 + g2 / 100) / (ke / 100 - g2 / 100) / rate**5
    enough = _c("n") >= 3
    return {"model": F.when(enough, F.when(gordon, "Gordon").otherwise("Two-stage")), "value": F.when(enough, F.when(gordon, one).otherwise(two))}
