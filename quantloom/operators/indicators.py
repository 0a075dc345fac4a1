"""Two indicator libraries over bars. ``a_*`` rounds half up to three digits and warms up with nulls; ``b_*`` does neither.

An indicator adds what it needs to a ``Build``: columns in layers, where a layer may look at those before it through windows, and recursions
in two scans. Names say what a column holds, so equal needs of several indicators meet in one column. A build then runs
as a whole: all windows share one sort by symbol and date, all recursions one scan (those that look at others, such as a
signal line, a second one), and the plan has one shuffle whatever the number of indicators. SAR, whose state
isn't affine, is a fold over a symbol's bars in Arrow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import folds
from quantloom.functions import windows as w
from quantloom.functions.recursions import Recursion, blend, by_alpha, decayed, scan, wilder

KEYS = ["symbol", "trade_date"]
_c = F.col

#: Layers 0 to 2 are columns, 3 a scan, 4 to 6 columns that may look at it, 7 the second scan.
FIRST_SCAN, SECOND_SCAN = 3, 7
Outputs = dict[str, Column]


class Build:
    def __init__(self) -> None:
        self.layers: list[dict] = [{} for _ in range(SECOND_SCAN + 1)]

    def column(self, layer: int, name: str, value: Column) -> str:
        self.layers[layer].setdefault(name, value)
        return name

    def recursion(self, layer: int, name: str, value: Recursion) -> Column:
        self.layers[layer].setdefault(name, value)
        return _c(name)

    def seed(self, scan_at: int, x: str, n: int) -> str:
        """The mean of the last ``n`` values at the first bar where all are there."""
        m = self.column(scan_at - 2, f"__{x}_mean{n}", w.mean(_c(x), n))
        return self.column(scan_at - 1, f"__{x}_seed{n}", F.when(F.count(m).over(w.so_far()) == 1, _c(m)))

    def seeded(self, x: str, n: int, kind: str, scan_at: int = FIRST_SCAN) -> Column:
        """``ema`` or ``wilder`` of span n, seeded with a mean; ``x`` is a column of layer ``scan_at`` - 3 at most."""
        step, keep = (blend(n), 1 - 2 / (n + 1)) if kind == "ema" else (wilder(n), (n - 1) / n)
        return self.recursion(scan_at, f"__{x}_{kind}{n}", Recursion(x, step, keep, self.seed(scan_at, x, n)))

    def from_first(self, x: str, alpha: float, scan_at: int = FIRST_SCAN) -> Column:
        """Exponential mean that starts with the first value."""
        first = self.column(scan_at - 1, f"__{x}_first", F.when(F.count(x).over(w.so_far()) == 1, _c(x)))
        return self.recursion(scan_at, f"__{x}_alpha{alpha!r}".replace(".", "_"), Recursion(x, by_alpha(alpha), 1 - alpha, first))

    def run(self, df: DataFrame) -> DataFrame:
        for k, layer in enumerate(self.layers):
            if layer:
                df = scan(df, layer) if k in (FIRST_SCAN, SECOND_SCAN) else df.withColumns(layer)
        return df


def _alone(indicator: Callable[..., Outputs]) -> Callable[..., DataFrame]:
    """The indicator on a panel: ``symbol, trade_date`` and its outputs."""

    def on(df: DataFrame, *args, **options) -> DataFrame:
        b = Build()
        out = indicator(b, *args, **options)
        return b.run(df).select(*KEYS, *[c.alias(k) for k, c in out.items()])

    on.__doc__ = indicator.__doc__
    return on


# --- library A -------------------------------------------------------------------------------------------------------


def _sma(b: Build, n: int = 5) -> Outputs:
    return {"sma": w.js_round(w.mean(_c("close"), n))}


def _ema(b: Build, n: int = 12) -> Outputs:
    return {"ema": w.js_round(b.seeded("close", n, "ema"))}


def _weighted(n: int) -> Column:
    parts = [(n - k) * (F.lag("close", k).over(w.by_symbol()) if k else _c("close")) for k in range(n)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return w.js_round(total / F.lit(n * (n + 1) / 2))


def _wma(b: Build, n: int = 5) -> Outputs:
    return {"wma": _weighted(n)}


def _ma(b: Build, periods: tuple[int, ...] = (5, 10, 20), kind: str = "sma") -> Outputs:
    make = {"sma": lambda n: w.js_round(w.mean(_c("close"), n)), "wma": _weighted, "ema": lambda n: w.js_round(b.seeded("close", n, "ema"))}[kind]
    return {f"ma{n}": make(n) for n in periods}


def _macd(b: Build, fast: int = 12, slow: int = 26, signal: int = 9) -> Outputs:
    """The signal line follows the difference of the rounded means."""
    dif = b.column(4, f"__dif{fast}_{slow}", w.js_round(b.seeded("close", fast, "ema")) - w.js_round(b.seeded("close", slow, "ema")))
    dea = w.js_round(b.seeded(dif, signal, "ema", SECOND_SCAN))
    return {"dif": w.js_round(_c(dif)), "dea": dea, "macd": w.js_round(2 * (_c(dif) - dea))}


def _boll(b: Build, n: int = 20, k: float = 2.0) -> Outputs:
    """The band's variance is taken about the rounded middle, over n."""
    mid = b.column(0, f"__middle{n}", w.js_round(w.mean(_c("close"), n)))
    # Summed about the middle: sums of squares less products would cancel for high prices with a small spread.
    xs = b.column(0, f"__closes{n}", F.collect_list("close").over(w.last(n)))
    sd = b.column(1, f"__band{n}", F.sqrt(F.aggregate(xs, F.lit(0.0), lambda s, v: s + (v - _c(mid)) * (v - _c(mid))) / n))
    upper, lower = _c(mid) + k * _c(sd), _c(mid) - k * _c(sd)
    return {"mid": _c(mid), "upper": w.js_round(upper), "lower": w.js_round(lower), "bandwidth": w.js_round(F.try_divide(2 * k * _c(sd), _c(mid)) * 100)}


def _stochastic(b: Build, n: int, m1: int, m2: int) -> Outputs:
    top, bottom = w.highest(_c("high"), n), w.lowest(_c("low"), n)
    raw = b.column(0, f"__rsv{n}", F.when(top > bottom, (_c("close") - bottom) / (top - bottom) * 100))
    # A bar without a raw value has no k and keeps the state.
    state = b.recursion(FIRST_SCAN, f"__k{n}_{m1}", Recursion(raw, wilder(m1), (m1 - 1) / m1, initial=50.0))
    k = b.column(4, f"__k{n}_{m1}_there", F.when(_c(raw).isNotNull(), state))
    d = F.when(_c(k).isNotNull(), b.recursion(SECOND_SCAN, f"__d{n}_{m1}_{m2}", Recursion(k, wilder(m2), (m2 - 1) / m2, initial=50.0)))
    return {"k": _c(k), "d": d, "j": 3 * _c(k) - 2 * d}


def _kdj(b: Build, n: int = 9, m1: int = 3, m2: int = 3) -> Outputs:
    return {k: w.js_round(x) for k, x in _stochastic(b, n, m1, m2).items()}


def _changes(b: Build) -> tuple[str, str]:
    """Gains and losses of layer 0; null on the first bar."""
    change = _c("close") - w.lag(_c("close"), 1)
    return tuple(b.column(0, k, F.when(change.isNotNull(), F.greatest(x, F.lit(0.0)))) for k, x in (("__gain", change), ("__loss", -change)))


def wilder_rsi(b: Build, n: int) -> Column:
    """Seeded with the means of the first n changes. No loss gives 100, no gain 0. A missing change holds both."""
    gain, loss = _changes(b)
    g, l = b.seeded(gain, n, "wilder"), b.seeded(loss, n, "wilder")
    return F.when(l == 0, 100.0).when(g == 0, 0.0).otherwise(100 - 100 / (1 + F.try_divide(g, l)))


def _rsi(b: Build, periods: tuple[int, ...] = (6, 12, 24)) -> Outputs:
    return {f"rsi{n}": w.js_round(wilder_rsi(b, n)) for n in periods}


def _wr(b: Build, periods: tuple[int, ...] = (6, 10)) -> Outputs:
    out = {}
    for n in periods:
        top, bottom = w.highest(_c("high"), n), w.lowest(_c("low"), n)
        out[f"wr{n}"] = w.js_round(F.when(top > bottom, (top - _c("close")) / (top - bottom) * 100))
    return out


def _bias(b: Build, periods: tuple[int, ...] = (6, 12, 24)) -> Outputs:
    ma = {n: w.js_round(w.mean(_c("close"), n)) for n in periods}
    return {f"bias{n}": w.js_round(F.try_divide(_c("close") - m, m) * 100) for n, m in ma.items()}


def _cci(b: Build, n: int = 14) -> Outputs:
    """Distance from the mean typical price in mean absolute deviations; 0 where these vanish."""
    tp = b.column(0, "__typical", (_c("high") + _c("low") + _c("close")) / 3)
    m, xs = b.column(1, f"__typical_mean{n}", w.mean(_c(tp), n)), b.column(1, f"__typicals{n}", F.collect_list(tp).over(w.last(n)))
    spread = F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.abs(x - _c(m))) / n
    md = b.column(2, f"__deviation{n}", F.when(_c(m).isNotNull(), spread))
    return {"cci": w.js_round(F.when(_c(md) == 0, 0.0).otherwise(F.try_divide(_c(tp) - _c(m), 0.015 * _c(md))))}


def _true_range(b: Build) -> str:
    """Layer 0; on the first bar high less low."""
    before = w.lag(_c("close"), 1)
    spans = F.greatest(_c("high") - _c("low"), F.abs(_c("high") - before), F.abs(_c("low") - before))
    return b.column(0, "__true_range", F.when(F.row_number().over(w.by_symbol()) == 1, _c("high") - _c("low")).when(before.isNotNull(), spans))


def _atr(b: Build, n: int = 14) -> Outputs:
    tr = _true_range(b)
    return {"tr": w.js_round(_c(tr)), "atr": w.js_round(b.seeded(tr, n, "wilder"))}


def _obv(b: Build) -> Outputs:
    """Starts with the first volume; later volumes count with the sign of the change."""
    change = _c("close") - w.lag(_c("close"), 1)
    signed = b.column(0, "__signed", F.when(change.isNull(), _c("volume")).otherwise(F.signum(change) * _c("volume")))
    return {"obv": F.sum(signed).over(w.so_far())}


def _roc(b: Build, n: int = 12, signal: int = 6) -> Outputs:
    before = w.lag(_c("close"), n)
    roc = b.column(0, f"__roc{n}", F.try_divide(_c("close") - before, before) * 100)
    return {"roc": _c(roc), "signal": w.mean(_c(roc), signal)}


def _kc(b: Build, n: int = 20, m: int = 10, k: float = 2.0) -> Outputs:
    """Rounded EMA plus and minus k rounded average true ranges."""
    mid, atr = w.js_round(b.seeded("close", n, "ema")), w.js_round(b.seeded(_true_range(b), m, "wilder"))
    return {"mid": mid, "upper": mid + k * atr, "lower": mid - k * atr}


def _dmi(b: Build, n: int = 14, m: int = 14) -> Outputs:
    """Directional movement: Wilder sums, DX, its mean ADX (seeded with a mean of m) and ADXR against m bars before."""
    rise, fall = _c("high") - w.lag(_c("high"), 1), w.lag(_c("low"), 1) - _c("low")
    moves = {
        "up": b.column(0, "__up", F.when((rise > fall) & (rise > 0), rise).otherwise(0.0)),
        "down": b.column(0, "__down", F.when((fall > rise) & (fall > 0), fall).otherwise(0.0)),
        "range": _true_range(b),
    }

    def total(x: str) -> Column:
        """The sum of bars 2 to n + 1, then of each bar and what is left of the sum."""
        seed = b.column(2, f"{x}_sum{n}_seed", F.when(F.row_number().over(w.by_symbol()) == n + 1, w.total(_c(x), n)))
        return b.recursion(FIRST_SCAN, f"{x}_sum{n}", Recursion(x, lambda s, v: s - s / n + v, 1 - 1 / n, seed))

    sums = {k: total(x) for k, x in moves.items()}
    pdi, mdi = (F.when(sums["range"] > 0, 100 * sums[k] / sums["range"]) for k in ("up", "down"))
    dx = b.column(4, f"__dx{n}", F.when(pdi + mdi > 0, 100 * F.abs(pdi - mdi) / (pdi + mdi)).when(pdi.isNotNull(), 0.0))
    adx = b.seeded(dx, m, "wilder", SECOND_SCAN)
    return {"pdi": pdi, "mdi": mdi, "adx": adx, "adxr": (adx + F.lag(adx, m).over(w.by_symbol())) / 2}


def a_sar(df: DataFrame, start: float = 0.02, step: float = 0.02, most: float = 0.2) -> DataFrame:
    return folds.scan(df, ["high", "low"], ["sar"], lambda high, low: {"sar": folds.sar(high, low, start, step, most)})


BUILT: dict[str, Callable[..., Outputs]] = {
    "sma": _sma, "ema": _ema, "wma": _wma, "ma": _ma, "macd": _macd, "boll": _boll, "kdj": _kdj, "rsi": _rsi, "wr": _wr, "bias": _bias,
    "cci": _cci, "atr": _atr, "obv": _obv, "roc": _roc, "kc": _kc, "dmi": _dmi,
}
FOLDED: dict[str, Callable[..., DataFrame]] = {"sar": a_sar}
a_sma, a_ema, a_wma, a_ma, a_macd, a_boll, a_kdj, a_rsi = map(_alone, (_sma, _ema, _wma, _ma, _macd, _boll, _kdj, _rsi))
a_wr, a_bias, a_cci, a_atr, a_obv, a_roc, a_kc, a_dmi = map(_alone, (_wr, _bias, _cci, _atr, _obv, _roc, _kc, _dmi))
INDICATORS: dict[str, Callable[..., DataFrame]] = {**{k: _alone(f) for k, f in BUILT.items()}, **FOLDED}
ALIASES = {"fastPeriod": "fast", "slowPeriod": "slow", "signalPeriod": "signal", "period": "n", "type": "kind"}


def normalize_options(options: bool | list | dict | None) -> dict:
    """``True`` for the defaults, a list for periods, a dict with aliases."""
    if options in (True, None):
        return {}
    if isinstance(options, list):
        return {"periods": tuple(options)}
    return {ALIASES.get(k, k): v for k, v in options.items()}


def calculate_indicators(df: DataFrame, wanted: dict[str, bool | list | dict]) -> DataFrame:
    """All wanted indicators of library A side by side, columns prefixed by the indicator's name, out of one build."""
    if not {"close"} <= set(df.columns):
        raise ValueError("bars need close")
    b, out = Build(), {}
    for name, options in wanted.items():
        if name not in INDICATORS:
            raise ValueError(f"no indicator {name!r}")
        if name in BUILT:
            out |= {f"{name}_{k}": c for k, c in BUILT[name](b, **normalize_options(options)).items()}
    t = b.run(df).select(*KEYS, *[c.alias(k) for k, c in out.items()])
    for name in (n for n in wanted if n in FOLDED):
        own = FOLDED[name](df, **normalize_options(wanted[name]))
        t = t.join(own.select(*KEYS, *[_c(c).alias(f"{name}_{c}") for c in own.columns if c not in KEYS]), KEYS, "left")
    return t


# --- library B -------------------------------------------------------------------------------------------------------


def _plain_ma(b: Build, n: int = 5) -> Outputs:
    return {"ma": F.avg("close").over(w.last(n))}


def _plain_ema(b: Build, n: int = 12) -> Outputs:
    return {"ema": b.from_first("close", 2 / (n + 1))}


def _plain_macd(b: Build, fast: int = 12, slow: int = 26, signal: int = 9) -> Outputs:
    dif = b.column(4, f"__plain_dif{fast}_{slow}", b.from_first("close", 2 / (fast + 1)) - b.from_first("close", 2 / (slow + 1)))
    dea = b.from_first(dif, 2 / (signal + 1), SECOND_SCAN)
    return {"dif": _c(dif), "dea": dea, "hist": _c(dif) - dea}


def _plain_rsi(b: Build, n: int = 14, method: str = "ema") -> Outputs:
    """``sma``: plain means; ``ema``: alpha 1/n, from 0 at the first bar, which has no change; ``china``: the same weights, normalised. No loss gives null.

    The weights of ``ema`` and ``china`` differ by one factor for both sums, so both are the ratio of decayed sums.
    """
    gain, loss = _changes(b)
    if method == "sma":
        g, l = F.avg(gain).over(w.last(n)), F.avg(loss).over(w.last(n))
    elif method in ("ema", "china"):
        keep = 1 - 1 / n
        g, l = (b.recursion(FIRST_SCAN, f"{x}_decayed{n}", Recursion(x, decayed(keep), keep, initial=0.0)) for x in (gain, loss))
    else:
        raise ValueError(f"no method {method!r}")
    return {"rsi": F.when(l != 0, 100 - 100 / (1 + F.try_divide(g, l)))}


def _plain_boll(b: Build, n: int = 20, k: float = 2.0) -> Outputs:
    mid, sd = F.avg("close").over(w.last(n)), F.stddev_samp("close").over(w.last(n))
    return {"mid": mid, "upper": mid + k * sd, "lower": mid - k * sd}


def _plain_atr(b: Build, n: int = 14) -> Outputs:
    return {"atr": w.mean(_c(_plain_range(b)), n)}


def _plain_range(b: Build) -> str:
    before = w.lag(_c("close"), 1)
    return b.column(0, "__plain_range", F.greatest(_c("high") - _c("low"), F.abs(_c("high") - before), F.abs(_c("low") - before)))


def _plain_kdj(b: Build, n: int = 9, m1: int = 3, m2: int = 3) -> Outputs:
    return _stochastic(b, n, m1, m2)


b_ma, b_ema, b_macd, b_rsi, b_boll, b_atr, b_kdj = map(_alone, (_plain_ma, _plain_ema, _plain_macd, _plain_rsi, _plain_boll, _plain_atr, _plain_kdj))


@dataclass(frozen=True)
class IndicatorSpec:
    """An indicator of library B by name, with parameters; ``period`` stands for ``n``."""

    name: str
    params: dict = field(default_factory=dict)

    def key(self) -> tuple:
        return self.name.lower(), tuple(sorted(self.params.items()))


#: By name: the indicator, the bars' columns it needs, its parameters with defaults, and its columns' names from parameters.
SPECS: dict[str, tuple] = {
    "ma": (_plain_ma, ["close"], {"n": 20}, lambda p: {"ma": f"ma{p['n']}"}),
    "ema": (_plain_ema, ["close"], {"n": 20}, lambda p: {"ema": f"ema{p['n']}"}),
    "macd": (_plain_macd, ["close"], {"fast": 12, "slow": 26, "signal": 9}, lambda p: {"dif": "dif", "dea": "dea", "hist": "macd_hist"}),
    "rsi": (_plain_rsi, ["close"], {"n": 14}, lambda p: {"rsi": f"rsi{p['n']}"}),
    "boll": (_plain_boll, ["close"], {"n": 20, "k": 2.0}, lambda p: {k: f"boll_{k}" for k in ("mid", "upper", "lower")}),
    "atr": (_plain_atr, ["high", "low", "close"], {"n": 14}, lambda p: {"atr": f"atr{p['n']}"}),
    "kdj": (_plain_kdj, ["high", "low", "close"], {"n": 9, "m1": 3, "m2": 3}, lambda p: {k: f"kdj_{k}" for k in "kdj"}),
}


def _outputs(b: Build, df: DataFrame, spec: IndicatorSpec) -> Outputs:
    if spec.name.lower() not in SPECS:
        raise ValueError(f"no indicator {spec.name!r}")
    make, needed, defaults, names = SPECS[spec.name.lower()]
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"bars need {', '.join(missing)}")
    given = {("n" if k == "period" and "n" in defaults else k): v for k, v in spec.params.items() if k != "period" or "n" not in spec.params}
    params = {k: type(v)(given.get(k, v)) for k, v in defaults.items()}
    renamed = names(params)
    return {renamed[k]: c for k, c in make(b, **params).items()}


def _appended(df: DataFrame, b: Build, out: Outputs) -> DataFrame:
    """``df`` with the outputs behind its columns; an output replaces a column of its name."""
    return b.run(df).select(*[_c(f"`{c}`") for c in df.columns if c not in out], *[c.alias(k) for k, c in out.items()])


def compute_indicator(df: DataFrame, spec: IndicatorSpec) -> DataFrame:
    """``df`` with the columns of one spec."""
    return compute_many(df, [spec])


def compute_many(df: DataFrame, specs: list[IndicatorSpec]) -> DataFrame:
    """``df`` with the columns of all specs, equal specs once, where they stand first; of unequal ones with equal column names the last one counts."""
    b, out, unique = Build(), {}, {}
    for spec in specs:
        unique.setdefault(spec.key(), spec)
    for spec in unique.values():
        out |= _outputs(b, df, spec)
    return _appended(df, b, out)


def add_all_indicators(df: DataFrame, rsi_style: str = "international") -> DataFrame:
    """Means of 5, 10, 20 and 60 bars, RSI in either style, MACD with a doubled histogram and the band, behind ``df``'s columns."""
    b = Build()
    out = {f"ma{n}": _plain_ma(b, n)["ma"] for n in (5, 10, 20, 60)}
    if rsi_style == "china":
        out |= {f"rsi{n}": _plain_rsi(b, n, "china")["rsi"] for n in (6, 12, 24)}
        out |= {"rsi14": _plain_rsi(b, 14, "sma")["rsi"], "rsi": out["rsi12"]}
    else:
        out["rsi"] = _plain_rsi(b, 14)["rsi"]
    macd = _plain_macd(b)
    out |= {"macd_dif": macd["dif"], "macd_dea": macd["dea"], "macd": macd["hist"] * 2}
    out |= {f"boll_{k}": c for k, c in _plain_boll(b).items()}
    return _appended(df, b, out)


def _out(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*KEYS, *[c.alias(k) for k, c in columns.items()])


def vwma(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean price weighted by volume."""
    return _out(df, vwma=F.try_divide(w.total(_c("close") * _c("volume"), n), w.total(_c("volume"), n)))


def mfi(df: DataFrame, n: int = 14) -> DataFrame:
    """Share of the money flow on rising typical prices, 0 to 100."""
    df = df.withColumn("tp", (_c("high") + _c("low") + _c("close")) / 3)
    df = df.withColumn("change", _c("tp") - w.lag(_c("tp"), 1))
    flow = _c("tp") * _c("volume")
    df = df.withColumn("up", F.when(_c("change").isNotNull(), F.when(_c("change") > 0, flow).otherwise(0.0)))
    df = df.withColumn("down", F.when(_c("change").isNotNull(), F.when(_c("change") < 0, flow).otherwise(0.0)))
    return _out(df, mfi=100 * F.try_divide(w.total(_c("up"), n), w.total(_c("up"), n) + w.total(_c("down"), n)))


def last_values(df: DataFrame) -> DataFrame:
    """The last row of each symbol."""
    rest = [c for c in df.columns if c not in KEYS]
    return df.groupBy("symbol").agg(F.max("trade_date").alias("trade_date"), F.max_by(F.struct(*rest), "trade_date").alias("r")).select(*KEYS, "r.*")
