"""Scalar functions on codes, dates, texts and prices, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the markets' code shapes.
SUFFIX_RULES = [("^(8|4|920)", "BJ"), ("^(6|9)", "SH")]
EXCHANGES = {"SH": "SSE", "SZ": "SZSE", "BJ": "BSE"}


def safe_float(x: Column) -> Column:
    """Null for null, NaN and what doesn't parse."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v), v)


def strip_prefix(x: Column) -> Column:
    """Without a leading or trailing exchange mark."""
    x = F.regexp_replace(x, "(?i)^(sh|sz|bj)[.]?", "")
    return F.regexp_replace(x, "(?i)[.]?(sh|sz|bj)$", "")


def code6(x: Column) -> Column:
    """The first six digits in a row, else null."""
    found = F.regexp_extract(x, r"\d{6}", 0)
    return F.when(found != "", found)


def pad6(x: Column) -> Column:
    """Zero-padded to six; longer ones as they are."""
    return F.when(F.length(x) >= 6, x).otherwise(F.lpad(x, 6, "0"))


def bare_code(x: Column) -> Column:
    """The part before the first point, without an exchange mark; null for empty ones, nan and none."""
    t = F.trim(x)
    return F.when((t != "") & ~F.lower(t).isin("nan", "none"), strip_prefix(F.split_part(t, F.lit("."), F.lit(1))))


def full_symbol(symbol: Column, market: Column) -> Column:
    """With the exchange's suffix: mainland codes by their first digit, Hong Kong's with HK, others as they are."""
    mainland = F.concat(symbol, F.when(symbol.startswith("6"), ".SH").otherwise(".SZ"))
    return F.when(market == "CN", mainland).when(market == "HK", F.concat(symbol, F.lit(".HK"))).otherwise(symbol)


def suffix(code: Column) -> Column:
    out = None
    for pattern, s in SUFFIX_RULES:
        out = F.when(code.rlike(pattern), s) if out is None else out.when(code.rlike(pattern), s)
    return out.otherwise("SZ")


def ts_code(x: Column) -> Column:
    c = pad6(strip_prefix(x))
    return F.concat(c, F.lit("."), suffix(c))


def exchange(s: Column) -> Column:
    return F.coalesce(*[F.when(s == k, v) for k, v in EXCHANGES.items()])


def currency(code: Column) -> Column:
    return F.when(F.upper(code).endswith(".HK"), "HKD").when(F.upper(code).endswith(".US"), "USD").otherwise("CNY")


def market_class(code: Column) -> Column:
    """Six digits: mainland; up to five digits, or .HK: Hong Kong; letters: United States."""
    c = F.upper(F.trim(code))
    return F.when(c.rlike(r"^\d{6}([.](SH|SZ|BJ))?$"), "CN").when(c.rlike(r"^\d{1,5}([.]HK)?$"), "HK").when(c.rlike(r"^[A-Z]{1,5}([.][A-Z])?$"), "US").otherwise("unknown")


def hk_code(x: Column) -> Column:
    c = F.regexp_replace(F.upper(F.trim(x)), "[.]HK$", "")
    return F.concat(F.lpad(F.regexp_replace(c, "^0+(?=.)", ""), 5, "0"), F.lit(".HK"))


def any_date(x: Column) -> Column:
    """yyyy-MM-dd, yyyy/MM/dd, yyyy.MM.dd, yyyyMMdd, with or without a time; else null."""
    day = F.regexp_replace(F.substring(F.trim(x), 1, 10), "[/.]", "-")
    dashed = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    plain = F.when(F.trim(x).rlike(r"^\d{8}($|\D)"), F.try_to_timestamp(F.substring(F.trim(x), 1, 8), F.lit("yyyyMMdd")))
    return F.coalesce(dashed, plain).cast("date")


def compact_date(x: Column) -> Column:
    return F.date_format(any_date(x), "yyyyMMdd")


def iso_date(x: Column) -> Column:
    return F.date_format(any_date(x), "yyyy-MM-dd")


def report_period(x: Column) -> Column:
    """The end of the period that a title names: year and first quarter, half, third quarter or whole year."""
    year = F.regexp_extract(x, r"(\d{4})", 1)
    end = F.when(x.rlike("一季|Q1"), "0331").when(x.rlike("中报|半年|H1"), "0630").when(x.rlike("三季|Q3"), "0930").when(x.rlike("年报|年度|FY"), "1231")
    return F.when((year != "") & end.isNotNull(), F.concat(year, end))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def trading_time(ts: Column, last: str = "15:30:00") -> Column:
    """Weekdays 9:30-11:30 and 13:00 to ``last``."""
    t = clock(ts)
    return (F.weekday(ts) < 5) & (t.between("09:30:00", "11:30:00") | t.between("13:00:00", last))


def pre_market(ts: Column) -> Column:
    t = clock(ts)
    return (F.weekday(ts) < 5) & (t >= "09:00:00") & (t < "09:30:00")


def after_market(ts: Column) -> Column:
    return (F.weekday(ts) < 5) & clock(ts).between("15:00:00", "15:30:00")


def trading_status(ts: Column) -> Column:
    t = clock(ts)
    return (
        F.when(F.weekday(ts) >= 5, "weekend").when(t < "09:00:00", "closed").when(t < "09:30:00", "pre_market").when(t <= "11:30:00", "morning")
        .when(t < "13:00:00", "noon_break").when(t <= "15:00:00", "afternoon").when(t <= "15:30:00", "after_market").otherwise("closed")
    )


#: Fees by market, as shares of the amount; ``min`` in currency. The second group counts on sales alone.
FEES = {
    "CN": {"rate": 0.0003, "min": 5.0, "stamp": 0.001},
    "HK": {"rate": 0.0003, "min": 3.0, "stamp": 0.001, "levy": 0.000027, "trading": 0.00005, "settlement": 0.00002},
    "US": {"rate": 0.0, "min": 0.0, "sec": 0.0000278},
}


def commission(market: Column, side: Column, amount: Column, rules: dict[str, dict[str, float]] | None = None) -> Column:
    """Commission, stamp duty on sales, Hong Kong's levies and, on sales in the United States, the SEC fee; 0 without rules."""
    out = F.lit(0.0)
    sale = F.when(side == "sell", amount).otherwise(0.0)
    for name, r in (FEES if rules is None else rules).items():
        fee = F.greatest(amount * r.get("rate", 0.0), F.lit(r.get("min", 0.0))) + sale * r.get("stamp", 0.0)
        if name == "HK":
            fee = fee + amount * (r.get("levy", 0.0) + r.get("trading", 0.0) + r.get("settlement", 0.0))
        if name == "US":
            fee = fee + sale * r.get("sec", 0.0)
        out = F.when(market == name, fee).otherwise(out)
    return out


SECRETS = ("password", "secret", "token", "api_key")


def sanitized(m: Column) -> Column:
    """A string map with the values of secret keys blanked."""
    hide = lambda k, v: F.when(F.lower(k).rlike("|".join(SECRETS)), F.lit("")).otherwise(v)
    return F.transform_values(m, hide)


# The words for each action.
ACTIONS = {
    "buy": "buy", "买入": "buy", "购买": "buy", "purchase": "buy",
    "hold": "hold", "持有": "hold", "保持": "hold", "keep": "hold",
    "sell": "sell", "卖出": "sell", "出售": "sell", "dispose": "sell",
}


def action(x: Column) -> Column:
    words = F.create_map(*[F.lit(y) for kv in ACTIONS.items() for y in kv])
    return F.coalesce(words[F.lower(F.trim(x))], F.lit("hold"))


# Patterns of a target price, in the order in which they are tried.
PRICE_PATTERNS = [
    r"目标价[位格]?[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"目标[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"价格[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"价位[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"合理[价位格]?[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"估值[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"[¥\$](\d+(?:\.\d+)?)",
    r"(\d+(?:\.\d+)?)元",
    r"(\d+(?:\.\d+)?)美元",
    r"建议[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"预期[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"看[到至]\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"上涨[到至]\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"(\d+(?:\.\d+)?)\s*[¥\$]",
]


def target_price(x: Column) -> Column:
    """The number of the first pattern that matches."""
    return F.coalesce(*[F.regexp_extract(x, p, 1).try_cast("double") for p in PRICE_PATTERNS])


def truncated(x: Column, most: int) -> Column:
    """Head and tail around a mark where the text is longer than ``most``."""
    head, tail = most * 7 // 10, most - most * 7 // 10 - 5
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, head), F.lit(" ... "), F.right(x, F.lit(tail))))


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, absolute error under 7.5e-8, in code generation."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


# Formats of a time, patterns of a current price and of a rise in percent, in the order in which they are tried, and
# what a decision adds to the current price without a percentage (in China and elsewhere).
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd"]
CURRENT_PATTERNS = [
    r"当前价[格位]?[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"现价[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"股价[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
    r"价格[：:]?\s*[¥\$]?(\d+(?:\.\d+)?)",
]
RISE_PATTERNS = [r"上涨\s*(\d+(?:\.\d+)?)%", r"涨幅\s*(\d+(?:\.\d+)?)%", r"增长\s*(\d+(?:\.\d+)?)%", r"(\d+(?:\.\d+)?)%\s*的?上涨"]
DEFAULT_MOVE = {"buy": (1.15, 1.12), "sell": (0.95, 0.92), "hold": (1.0, 1.0)}


def parsed_time(x: Column, otherwise: Column) -> Column:
    """A time by the first format that fits the whole text; ``otherwise`` if none does, null for null."""
    return F.when(x.isNotNull(), F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in TIME_FORMATS], otherwise))


def guessed_price(x: Column, decision: Column, china: bool = True) -> Column:
    """A target from the text's current price (null without) and its rise in percent, or else by the decision's usual move."""
    first = lambda patterns: F.coalesce(*[F.regexp_extract(x, p, 1).try_cast("double") for p in patterns])
    now, rise = first(CURRENT_PATTERNS), first(RISE_PATTERNS) / 100
    now, rise = F.when(now != 0, now), F.when(rise != 0, rise)
    usual = F.coalesce(*[F.when(decision == k, F.lit(v[0 if china else 1])) for k, v in DEFAULT_MOVE.items()])
    told = F.when(decision == "buy", now * (1 + rise)).when(decision == "sell", now * (1 - rise))
    return F.when(decision == "hold", now).otherwise(F.round(F.coalesce(told, now * usual), 2))
