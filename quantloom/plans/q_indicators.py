"""Queries of both indicator libraries on weekly bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import indicators as ind
from quantloom.sources.bars import BARS, weekly_brand_bars

from .q_panel import S, full_sql, n_rows, windowed

NUM = f"{BARS}, num AS (SELECT *, row_number() OVER ({S}) AS rn, lag(close) OVER ({S}) AS before, (high + low + close) / 3 AS tp FROM bars)"


def _r(x: str) -> str:
    return f"(floor(({x}) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE)"


def _query(f: Callable[..., DataFrame], **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = f(weekly_brand_bars(spark, sf_dir), **options)
        return t.select(*ind.KEYS, *[F.round(c, 5).alias(c) for c in t.columns if c not in ind.KEYS])

    return run


def _sql(columns: dict[str, str], at: str = "num", more: str = "") -> str:
    return f"WITH RECURSIVE {NUM}{more} SELECT symbol, trade_date, " + ", ".join(f"round(({v})::DOUBLE, 5) AS {k}" for k, v in columns.items()) + f" FROM {at}"


def ema_cte(name: str, source: str, column: str, n: int) -> str:
    """Seeded EMA of ``column`` (null before its first value) of ``source`` (symbol, rn): ``name`` (symbol, rn, e)."""
    return f""", {name}_s AS (SELECT symbol, rn, {column} AS x, avg({column}) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m,
        count({column}) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c FROM {source}),
    {name}_0 AS (SELECT symbol, min(rn) AS rn FROM {name}_s WHERE c = {n} GROUP BY symbol),
    {name} AS (SELECT s.symbol, s.rn, s.m AS e FROM {name}_s s JOIN {name}_0 USING (symbol, rn)
        UNION ALL SELECT s.symbol, s.rn, 2.0::DOUBLE / {n + 1} * s.x + (1 - 2.0::DOUBLE / {n + 1}) * p.e FROM {name} p JOIN {name}_s s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


def first_ema_cte(name: str, source: str, column: str, alpha: str, start: int = 1) -> str:
    return f""", {name} AS (SELECT symbol, rn, ({column})::DOUBLE AS e FROM {source} WHERE rn = {start}
        UNION ALL SELECT s.symbol, s.rn, {alpha} * s.{column} + (1 - {alpha}) * p.e FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


def smooth_cte(name: str, source: str, column: str, n: int, start: int, seed: str) -> str:
    """(state * (n - 1) + x) / n from ``seed`` at row ``start``."""
    return f""", {name} AS (SELECT symbol, rn, ({seed})::DOUBLE AS e FROM {source} WHERE rn = {start}
        UNION ALL SELECT s.symbol, s.rn, (p.e * {n - 1} + s.{column}) / {n} FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


_two = ema_cte("f", "num", "close", 12) + ema_cte("g", "num", "close", 26)
MACD = _two + f", dif AS (SELECT symbol, rn, {_r('f.e')} - {_r('g.e')} AS d FROM f JOIN g USING (symbol, rn))" + ema_cte("h", "dif", "d", 9)
MACD += ", out AS (SELECT num.symbol, num.trade_date, dif.d, h.e FROM num LEFT JOIN dif USING (symbol, rn) LEFT JOIN h USING (symbol, rn))"

_rsv = (
    f", rsv AS (SELECT *, CASE WHEN rn >= 9 AND max(high) OVER {n_rows(9)} > min(low) OVER {n_rows(9)} THEN (close - min(low) OVER {n_rows(9)}) / (max(high) OVER {n_rows(9)} - min(low) OVER {n_rows(9)}) * 100 END AS rsv FROM num)"
)
KDJ = _rsv + smooth_cte("kk", "rsv", "rsv", 3, 9, "(50 * 2 + rsv) / 3.0::DOUBLE") + ", kd AS (SELECT symbol, rn, e AS k FROM kk)" + smooth_cte("dd", "kd", "k", 3, 9, "(50 * 2 + k) / 3.0::DOUBLE")
KDJ += ", out AS (SELECT num.symbol, num.trade_date, kk.e AS k, dd.e AS d FROM num LEFT JOIN kk USING (symbol, rn) LEFT JOIN dd USING (symbol, rn))"

KDJ_4 = _rsv + smooth_cte("kk", "rsv", "rsv", 4, 9, "(50 * 3 + rsv) / 4.0::DOUBLE") + ", kd AS (SELECT symbol, rn, e AS k FROM kk)" + smooth_cte("dd", "kd", "k", 3, 9, "(50 * 2 + k) / 3.0::DOUBLE")
KDJ_4 += ", out AS (SELECT num.symbol, num.trade_date, num.close, kk.e AS k, dd.e AS d FROM num LEFT JOIN kk USING (symbol, rn) LEFT JOIN dd USING (symbol, rn))"

TR = ", tr AS (SELECT *, CASE WHEN rn = 1 THEN high - low ELSE greatest(high - low, abs(high - before), abs(low - before)) END AS tr FROM num), trm AS (SELECT *, avg(tr) OVER " + n_rows(14) + " AS m FROM tr)"
ATR = TR + smooth_cte("w", "trm", "tr", 14, 14, "m") + ", out AS (SELECT tr.symbol, tr.trade_date, tr.tr, w.e FROM tr LEFT JOIN w USING (symbol, rn))"

_gl = ", gl AS (SELECT *, greatest(close - before, 0) AS g, greatest(before - close, 0) AS l FROM num)"


def rsi_cte(n: int) -> str:
    means = f", m{n} AS (SELECT *, avg(g) OVER {n_rows(n)} AS mg, avg(l) OVER {n_rows(n)} AS ml FROM gl WHERE rn > 1)"
    return means + smooth_cte(f"g{n}", f"m{n}", "g", n, n + 1, "mg") + smooth_cte(f"l{n}", f"m{n}", "l", n, n + 1, "ml")


RSI = _gl + "".join(map(rsi_cte, (6, 12, 24)))
RSI += ", out AS (SELECT num.symbol, num.trade_date, " + ", ".join(f"g{n}.e AS g{n}, l{n}.e AS l{n}" for n in (6, 12, 24)) + " FROM num " + " ".join(f"LEFT JOIN g{n} USING (symbol, rn) LEFT JOIN l{n} USING (symbol, rn)" for n in (6, 12, 24)) + ")"

B_MACD = first_ema_cte("f", "num", "close", "(2.0::DOUBLE / 13)") + first_ema_cte("g", "num", "close", "(2.0::DOUBLE / 27)") + ", dif AS (SELECT symbol, rn, f.e - g.e AS d FROM f JOIN g USING (symbol, rn))" + first_ema_cte("h", "dif", "d", "0.2::DOUBLE")
# The first bar has no change: gain and loss are 0 there, and the means start from it.
B_RSI = _gl + first_ema_cte("g1", "gl", "g", "(1.0::DOUBLE / 14)") + first_ema_cte("l1", "gl", "l", "(1.0::DOUBLE / 14)")


def _decayed_cte(n: int) -> str:
    return f""", cs{n} AS (SELECT symbol, rn, 0::DOUBLE AS g, 0::DOUBLE AS l FROM gl WHERE rn = 1
        UNION ALL SELECT s.symbol, s.rn, p.g * (1 - 1.0::DOUBLE / {n}) + s.g, p.l * (1 - 1.0::DOUBLE / {n}) + s.l FROM cs{n} p JOIN gl s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


CHINA = _gl + """, cs AS (SELECT symbol, rn, g::DOUBLE AS g, l::DOUBLE AS l FROM gl WHERE rn = 2
    UNION ALL SELECT s.symbol, s.rn, p.g * (13.0::DOUBLE / 14) + s.g, p.l * (13.0::DOUBLE / 14) + s.l FROM cs p JOIN gl s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""

_var = f"(sum(close * close) OVER {n_rows(20)} - 2 * mid * sum(close) OVER {n_rows(20)} + 20 * mid * mid) / 20"
_mid = f", mid AS (SELECT *, {_r(windowed('avg', 'close', 20))} AS mid FROM num), sd AS (SELECT *, sqrt(greatest({_var}, 0)) AS sd FROM mid)"
_cci = f", cm AS (SELECT *, {windowed('avg', 'tp', 14)} AS m, list(tp) OVER {n_rows(14)} AS xs FROM num), cd AS (SELECT *, list_sum(list_transform(xs, lambda q: abs(q - m))) / 14 AS md FROM cm)"
_flow = f", fl AS (SELECT *, tp - lag(tp) OVER ({S}) AS change FROM num), fu AS (SELECT *, CASE WHEN change > 0 THEN tp * volume WHEN change IS NOT NULL THEN 0 END AS up, CASE WHEN change < 0 THEN tp * volume WHEN change IS NOT NULL THEN 0 END AS down FROM fl)"

def _sum_cte(name: str, x: str) -> str:
    """Sum of rows 2 to 15, then less a fourteenth of itself plus the row's value."""
    return f""", {name} AS (SELECT symbol, rn, (SELECT sum(d.{x}) FROM dm d WHERE d.symbol = s.symbol AND d.rn BETWEEN 2 AND 15)::DOUBLE AS e FROM dm s WHERE rn = 15
        UNION ALL SELECT s.symbol, s.rn, p.e - p.e / 14 + s.{x} FROM {name} p JOIN dm s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


_MOVES = f", dm AS (SELECT *, CASE WHEN high - h1 > l1 - low AND high - h1 > 0 THEN high - h1 ELSE 0 END AS up, CASE WHEN l1 - low > high - h1 AND l1 - low > 0 THEN l1 - low ELSE 0 END AS down FROM (SELECT *, lag(high) OVER ({S}) AS h1, lag(low) OVER ({S}) AS l1 FROM tr))"
DMI = TR + _MOVES + _sum_cte("su", "up") + _sum_cte("sd", "down") + _sum_cte("st", "tr")
DMI += """, di AS (SELECT symbol, rn, CASE WHEN st.e > 0 THEN 100 * su.e / st.e END AS pdi, CASE WHEN st.e > 0 THEN 100 * sd.e / st.e END AS mdi FROM su JOIN sd USING (symbol, rn) JOIN st USING (symbol, rn)),
    dx AS (SELECT *, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) WHEN pdi IS NOT NULL THEN 0 END AS dx FROM di), dxm AS (SELECT *, avg(dx) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS m FROM dx)"""
DMI += smooth_cte("ax", "dxm", "dx", 14, 28, "m") + ", out AS (SELECT num.symbol, num.trade_date, pdi, mdi, ax.e AS adx, (ax.e + lag(ax.e, 14) OVER (PARTITION BY num.symbol ORDER BY num.rn)) / 2 AS adxr FROM num LEFT JOIN dx USING (symbol, rn) LEFT JOIN ax USING (symbol, rn))"

#: The state is (long, stop, extreme, factor); q is the stop before it may turn.
SAR = f""", sb AS (SELECT *, lag(high) OVER ({S}) AS h1, lag(low) OVER ({S}) AS l1, lag(high, 2) OVER ({S}) AS h2, lag(low, 2) OVER ({S}) AS l2 FROM num),
    sr AS (SELECT symbol, rn, high >= h1 AS up, CASE WHEN high >= h1 THEN l1 ELSE h1 END::DOUBLE AS stop, CASE WHEN high >= h1 THEN high ELSE low END::DOUBLE AS top, 0.02::DOUBLE AS f FROM sb WHERE rn = 2
        UNION ALL SELECT symbol, rn, up <> turned, CASE WHEN turned THEN top ELSE q END, CASE WHEN turned AND up THEN low WHEN turned THEN high WHEN up THEN greatest(top, high) ELSE least(top, low) END,
            CASE WHEN turned THEN 0.02::DOUBLE WHEN (up AND high > top) OR (NOT up AND low < top) THEN least(0.2::DOUBLE, f + 0.02::DOUBLE) ELSE f END
        FROM (SELECT *, CASE WHEN up THEN low < q ELSE high > q END AS turned FROM (
            SELECT s.symbol, s.rn, s.high, s.low, p.up, p.top, p.f, CASE WHEN p.up THEN least(p.stop + p.f * (p.top - p.stop), l1, l2) ELSE greatest(p.stop + p.f * (p.top - p.stop), h1, h2) END AS q
            FROM sr p JOIN sb s ON s.symbol = p.symbol AND s.rn = p.rn + 1)))"""

_ALL = {
    **{f"ma{n}": f"avg(close) OVER {n_rows(n)}" for n in (5, 10, 20, 60)}, "macd_dif": "d", "macd_dea": "h.e", "macd": "2 * (d - h.e)",
    "boll_mid": f"avg(close) OVER {n_rows(20)}", "boll_upper": f"avg(close) OVER {n_rows(20)} + 2 * stddev_samp(close) OVER {n_rows(20)}",
    "boll_lower": f"avg(close) OVER {n_rows(20)} - 2 * stddev_samp(close) OVER {n_rows(20)}",
}
_MANY = [("MA", {"n": 10}), ("ema", {"period": 12}), ("macd", {}), ("rsi", {}), ("boll", {"n": 10}), ("atr", {}), ("kdj", {}), ("ma", {"n": 10}), ("boll", {"n": 20, "k": 2})]


def _rows(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """New columns of ``f`` on bars without their own columns but the close."""
    return _query(lambda df: f(df).drop("open", "high", "low", "volume", "amount"))


QUERIES = {
    "ind_sma": _query(ind.a_sma), "ind_ema": _query(ind.a_ema), "ind_wma": _query(ind.a_wma), "ind_ma": _query(ind.a_ma), "ind_macd": _query(ind.a_macd),
    "ind_boll": _query(ind.a_boll), "ind_kdj": _query(ind.a_kdj), "ind_rsi": _query(ind.a_rsi), "ind_wr": _query(ind.a_wr), "ind_bias": _query(ind.a_bias),
    "ind_cci": _query(ind.a_cci), "ind_atr": _query(ind.a_atr), "ind_obv": _query(ind.a_obv), "ind_roc": _query(ind.a_roc), "ind_dmi": _query(ind.a_dmi),
    "ind_sar": _query(ind.a_sar), "ind_kc": _query(ind.a_kc),
    "ind_batch": _query(ind.calculate_indicators, wanted={"sma": {"period": 5}, "wr": [6, 10], "obv": True}),
    "ind_normalize": _query(ind.calculate_indicators, wanted={"macd": {"fastPeriod": 12, "slowPeriod": 26}, "ma": [5, 10], "atr": True, "kdj": None, "ema": {"period": 12}}),
    "b_ma": _query(ind.b_ma), "b_ema": _query(ind.b_ema), "b_macd": _query(ind.b_macd), "b_rsi": _query(ind.b_rsi), "b_rsi_sma": _query(ind.b_rsi, method="sma"),
    "b_rsi_china": _query(ind.b_rsi, method="china"), "b_boll": _query(ind.b_boll), "b_atr": _query(ind.b_atr), "b_kdj": _query(ind.b_kdj),
    "b_one": _rows(lambda df: ind.compute_indicator(df, ind.IndicatorSpec("KDJ", {"m1": 4}))),
    "b_many": _rows(lambda df: ind.compute_many(df, [ind.IndicatorSpec(k, p) for k, p in _MANY])),
    "b_all": _rows(ind.add_all_indicators), "b_all_china": _rows(lambda df: ind.add_all_indicators(df, "china")),
    "b_last": _query(lambda df: ind.last_values(ind.b_boll(df))), "vwma": _query(ind.vwma), "mfi": _query(ind.mfi),
}

_ma = lambda n: _r(windowed("avg", "close", n))
_wr = lambda n: _r(f"CASE WHEN rn >= {n} AND max(high) OVER {n_rows(n)} > min(low) OVER {n_rows(n)} THEN (max(high) OVER {n_rows(n)} - close) / (max(high) OVER {n_rows(n)} - min(low) OVER {n_rows(n)}) * 100 END")
_rsi = lambda g, l: f"CASE WHEN {l} = 0 THEN 100 WHEN {g} = 0 THEN 0 ELSE 100 - 100 / (1 + {g} / {l}) END"
_obv = f"sum(CASE WHEN before IS NULL THEN volume ELSE sign(close - before) * volume END) OVER ({S})"
ORACLES = {
    "ind_sma": _sql({"sma": _ma(5)}),
    "ind_ema": _sql({"ema": _r("e")}, "num LEFT JOIN f USING (symbol, rn)", ema_cte("f", "num", "close", 12)),
    "ind_wma": _sql({"wma": _r("(5 * close" + "".join(f" + {5 - k} * lag(close, {k}) OVER ({S})" for k in range(1, 5)) + ") / 15")}),
    "ind_ma": _sql({f"ma{n}": _ma(n) for n in (5, 10, 20)}),
    "ind_macd": _sql({"dif": _r("d"), "dea": _r("e"), "macd": _r(f"2 * (d - {_r('e')})")}, "out", MACD),
    "ind_boll": _sql({"mid": "mid", "upper": _r("mid + 2 * sd"), "lower": _r("mid - 2 * sd"), "bandwidth": _r("4 * sd / mid * 100")}, "sd", _mid),
    "ind_kdj": _sql({"k": _r("k"), "d": _r("d"), "j": _r("3 * k - 2 * d")}, "out", KDJ),
    "ind_rsi": _sql({f"rsi{n}": _r(_rsi(f"g{n}", f"l{n}")) for n in (6, 12, 24)}, "out", RSI),
    "ind_wr": _sql({"wr6": _wr(6), "wr10": _wr(10)}),
    "ind_bias": _sql({f"bias{n}": _r(f"(close - {_ma(n)}) / {_ma(n)} * 100") for n in (6, 12, 24)}),
    "ind_cci": _sql({"cci": _r("CASE WHEN md = 0 THEN 0 ELSE (tp - m) / (0.015::DOUBLE * md) END")}, "cd", _cci),
    "ind_atr": _sql({"tr": _r("tr"), "atr": _r("e")}, "out", ATR),
    "ind_obv": _sql({"obv": _obv}),
    "ind_roc": _sql({"roc": "roc", "signal": windowed("avg", "roc", 6)}, "r", f", r AS (SELECT *, (close - lag(close, 12) OVER ({S})) / lag(close, 12) OVER ({S}) * 100 AS roc FROM num)"),
    "ind_dmi": _sql({"pdi": "pdi", "mdi": "mdi", "adx": "adx", "adxr": "adxr"}, "out", DMI),
    "ind_sar": _sql({"sar": "stop"}, "num LEFT JOIN sr USING (symbol, rn)", SAR),
    "ind_kc": _sql({"mid": _r("f.e"), "upper": f"{_r('f.e')} + 2 * {_r('w.e')}", "lower": f"{_r('f.e')} - 2 * {_r('w.e')}"}, "num LEFT JOIN f USING (symbol, rn) LEFT JOIN w USING (symbol, rn)",
        ema_cte("f", "num", "close", 20) + TR.replace("BETWEEN 13", "BETWEEN 9") + smooth_cte("w", "trm", "tr", 10, 10, "m")),
    "ind_batch": _sql({"sma_sma": _ma(5), "wr_wr6": _wr(6), "wr_wr10": _wr(10), "obv_obv": _obv}),
    "ind_normalize": _sql({"macd_dif": _r("dif.d"), "macd_dea": _r("h.e"), "macd_macd": _r(f"2 * (dif.d - {_r('h.e')})"), "ma_ma5": _ma(5), "ma_ma10": _ma(10), "atr_tr": _r("tr.tr"), "atr_atr": _r("w.e"),
        "kdj_k": _r("k"), "kdj_d": _r("o.d"), "kdj_j": _r("3 * k - 2 * o.d"), "ema_ema": _r("f.e")},
        "num LEFT JOIN f USING (symbol, rn) LEFT JOIN dif USING (symbol, rn) LEFT JOIN h USING (symbol, rn) LEFT JOIN (SELECT symbol, rn, tr FROM tr) tr USING (symbol, rn) LEFT JOIN w USING (symbol, rn) LEFT JOIN (SELECT num.symbol, num.rn, k, d FROM out JOIN num USING (symbol, trade_date)) o USING (symbol, rn)",
        MACD.split(", out AS")[0] + TR + smooth_cte("w", "trm", "tr", 14, 14, "m") + KDJ),
    "b_ma": _sql({"ma": f"avg(close) OVER {n_rows(5)}"}),
    "b_ema": _sql({"ema": "e"}, "num JOIN f USING (symbol, rn)", first_ema_cte("f", "num", "close", "(2.0::DOUBLE / 13)")),
    "b_macd": _sql({"dif": "d", "dea": "h.e", "hist": "d - h.e"}, "num JOIN dif USING (symbol, rn) JOIN h USING (symbol, rn)", B_MACD),
    "b_rsi": _sql({"rsi": "CASE WHEN l1.e <> 0 THEN 100 - 100 / (1 + g1.e / l1.e) END"}, "num LEFT JOIN g1 USING (symbol, rn) LEFT JOIN l1 USING (symbol, rn)", B_RSI),
    "b_rsi_sma": _sql({"rsi": "CASE WHEN ml <> 0 THEN 100 - 100 / (1 + mg / ml) END"}, "m", _gl + f", gn AS (SELECT *, CASE WHEN before IS NOT NULL THEN g END AS gg, CASE WHEN before IS NOT NULL THEN l END AS ll FROM gl), m AS (SELECT *, avg(gg) OVER {n_rows(14)} AS mg, avg(ll) OVER {n_rows(14)} AS ml FROM gn)"),
    "b_rsi_china": _sql({"rsi": "CASE WHEN l <> 0 THEN 100 - 100 / (1 + g / l) END"}, "num LEFT JOIN cs USING (symbol, rn)", CHINA),
    "b_boll": _sql({"mid": f"avg(close) OVER {n_rows(20)}", "upper": f"avg(close) OVER {n_rows(20)} + 2 * stddev_samp(close) OVER {n_rows(20)}", "lower": f"avg(close) OVER {n_rows(20)} - 2 * stddev_samp(close) OVER {n_rows(20)}"}),
    "b_atr": _sql({"atr": full_sql("tr", 14, f"avg(tr) OVER {n_rows(14)}")}, "tr", TR),
    "b_kdj": _sql({"k": "k", "d": "d", "j": "3 * k - 2 * d"}, "out", KDJ),
    "b_one": _sql({"close": "close", "kdj_k": "k", "kdj_d": "d", "kdj_j": "3 * k - 2 * d"}, "out", KDJ_4),
    "b_many": _sql({"close": "num.close", "ma10": f"avg(num.close) OVER {n_rows(10)}", "ema12": "f.e", "dif": "f.e - g.e", "dea": "h.e", "macd_hist": "f.e - g.e - h.e",
        "rsi14": "CASE WHEN l1.e <> 0 THEN 100 - 100 / (1 + g1.e / l1.e) END", "atr14": "atr", "kdj_k": "k", "kdj_d": "d", "kdj_j": "3 * k - 2 * d",
        **{k: v.replace("(close)", "(num.close)") for k, v in _ALL.items() if k.startswith("boll")}},
        "num JOIN f USING (symbol, rn) JOIN g USING (symbol, rn) JOIN h USING (symbol, rn) JOIN g1 USING (symbol, rn) JOIN l1 USING (symbol, rn) "
        f"JOIN (SELECT symbol, rn, {full_sql('tr', 14, f'avg(tr) OVER {n_rows(14)}')} AS atr FROM tr) USING (symbol, rn) LEFT JOIN (SELECT num.symbol, num.rn, k, d FROM out JOIN num USING (symbol, trade_date)) USING (symbol, rn)",
        B_MACD + B_RSI + TR + KDJ),
    "b_all": _sql(_ALL | {"close": "close", "rsi": "CASE WHEN l1.e <> 0 THEN 100 - 100 / (1 + g1.e / l1.e) END"},
        "num JOIN dif USING (symbol, rn) JOIN h USING (symbol, rn) JOIN g1 USING (symbol, rn) JOIN l1 USING (symbol, rn)", B_MACD + B_RSI),
    "b_all_china": _sql(_ALL | {"close": "close", "rsi14": "CASE WHEN ml <> 0 THEN 100 - 100 / (1 + mg / ml) END",
        **{k: f"CASE WHEN cs{n}.l <> 0 THEN 100 - 100 / (1 + cs{n}.g / cs{n}.l) END" for k, n in (("rsi6", 6), ("rsi12", 12), ("rsi24", 24), ("rsi", 12))}},
        "num JOIN dif USING (symbol, rn) JOIN h USING (symbol, rn) JOIN (SELECT symbol, rn, avg(g) OVER " + n_rows(14) + " AS mg, avg(l) OVER " + n_rows(14) + " AS ml FROM gl) USING (symbol, rn) "
        + " ".join(f"JOIN cs{n} USING (symbol, rn)" for n in (6, 12, 24)), B_MACD + _gl + "".join(map(_decayed_cte, (6, 12, 24)))),
    "b_last": _sql({"mid": "m", "upper": "m + 2 * s", "lower": "m - 2 * s"}, "l", f", l AS (SELECT symbol, trade_date, avg(close) OVER {n_rows(20)} AS m, stddev_samp(close) OVER {n_rows(20)} AS s FROM num QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1)"),
    "vwma": _sql({"vwma": full_sql("close", 14, f"sum(close * volume) OVER {n_rows(14)} / sum(volume) OVER {n_rows(14)}")}),
    "mfi": _sql({"mfi": full_sql("up", 14, f"100 * sum(up) OVER {n_rows(14)} / nullif(sum(up) OVER {n_rows(14)} + sum(down) OVER {n_rows(14)}, 0)")}, "fu", _flow),
}
