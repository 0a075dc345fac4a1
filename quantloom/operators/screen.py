"""The screening language, compiled to Columns.

Flat: a list of ``{"field", "operator", "value"}``, all of which must hold; unknown fields are skipped, and of several
conditions on one field the last counts. Comparisons never match null, except ``!=`` and ``not_in``, which do.

Tree: ``{"logic": "AND" | "OR", "children": [...]}`` over leaves ``{"field", "op", "value" | "right_field"}``. A null on
the left is no match for any operator; an unknown field or operator is false, and so is a cross without a right field or a
``between`` without two values; unknown logic means AND.

Conditions are for filters: where nothing matches because of a null they give null, not false, so that plain comparisons
reach the scan (``PushedFilters``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT = {">", "<", ">=", "<=", "==", "!=", "between", "in", "not_in", "contains"}


def _compare(c: Column, op: str, v: object) -> Column:
    return {">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v, "==": c == v}[op]


def flat(conditions: list[dict], fields: set[str]) -> Column:
    """The conjunction of a flat list over the given fields."""
    last = {}
    for x in conditions:
        if x["field"] in fields:
            op, v = x["operator"], x["value"]
            if op not in FLAT:
                raise ValueError(f"no operator {op!r}")
            if op == "between" and (not isinstance(v, list | tuple) or len(v) != 2):
                continue
            last[x["field"]] = (op, v)
    out = F.lit(True)
    for field, (op, v) in last.items():
        c = F.col(field)
        if op == "between":
            e = c.between(*v)
        elif op == "in":
            e = c.isin(list(v))
        elif op == "not_in":
            e = ~c.isin(list(v)) | c.isNull()
        elif op == "!=":
            e = ~c.eqNullSafe(v)
        elif op == "contains":
            e = c.rlike("(?i)" + str(v))
        else:
            e = _compare(c, op, v)
        out = out & e
    return out


def _before(c: Column) -> Column:
    return F.lag(c).over(Window.partitionBy("symbol").orderBy("trade_date"))


def leaf(x: dict, fields: set[str]) -> Column:
    op = x.get("op", x.get("operator"))
    if x["field"] not in fields or ("right_field" in x and x["right_field"] not in fields):
        return F.lit(False)
    a = F.col(x["field"])
    b = F.col(x["right_field"]) if "right_field" in x else x.get("value")
    if op in ("cross_up", "cross_down"):
        if "right_field" not in x:
            return F.lit(False)
        return (_before(a) <= _before(b)) & (a > b) if op == "cross_up" else (_before(a) >= _before(b)) & (a < b)
    if op == "between":
        return a.between(*b) if isinstance(b, list | tuple) and len(b) == 2 else F.lit(False)
    if op == "!=":
        return a != b
    return _compare(a, op, b) if op in (">", "<", ">=", "<=", "==") else F.lit(False)


def tree(node: dict | None, fields: set[str], foreign: bool | None = None) -> Column:
    """A tree over a panel. ``foreign``: what a leaf on a field outside ``fields`` gives (default: false)."""
    if not node:
        return F.lit(True)
    if "children" in node:
        parts = [tree(c, fields, foreign) for c in node["children"]]
        if not parts:
            return F.lit(True)
        return reduce(lambda a, b: a | b if str(node.get("logic", "AND")).upper() == "OR" else a & b, parts)
    if foreign is not None and node["field"] not in fields:
        return F.lit(foreign)
    return leaf(node, fields)


def fields_of(node: dict) -> list[str]:
    """The fields a tree names, each once, in order."""
    if "children" in node:
        found = [f for c in node["children"] for f in fields_of(c)]
    else:
        found = [node["field"], *([node["right_field"]] if "right_field" in node else [])]
    return list(dict.fromkeys(found))


def on_last_bar(panel: DataFrame, node: dict) -> DataFrame:
    """Symbols whose last bar satisfies the tree."""
    test = tree(node, set(panel.columns))
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))
    return panel.withColumn("__ok", test).withColumn("__rn", newest).where("__rn = 1 and __ok").drop("__ok", "__rn")


def page(df: DataFrame, order: list[tuple[str, str]], limit: int, offset: int = 0, tie: str = "code") -> DataFrame:
    """Ordered by the known fields (nulls last), ties by ``tie``, ``limit`` rows from ``offset`` on."""
    keys = [F.col(f).desc_nulls_last() if d == "desc" else F.col(f).asc_nulls_last() for f, d in order if f in df.columns]
    return df.orderBy(*keys, F.col(tie)).offset(offset).limit(limit)


def validate(conditions: list[dict], kinds: dict[str, str]) -> list[str]:
    """What is wrong with each condition; ``kinds`` maps a field to ``number`` or ``string``."""
    out = []
    for k, x in enumerate(conditions):
        kind, op, v = kinds.get(x.get("field")), x.get("operator"), x.get("value")
        if kind is None:
            out.append(f"{k}: no field {x.get('field')!r}")
        elif op not in FLAT:
            out.append(f"{k}: no operator {op!r}")
        elif op == "between" and not (isinstance(v, list | tuple) and len(v) == 2):
            out.append(f"{k}: between takes two values")
        elif op in ("in", "not_in") and not isinstance(v, list | tuple):
            out.append(f"{k}: {op} takes a list")
        elif kind == "number" and op in (">", "<", ">=", "<=") and not isinstance(v, int | float):
            out.append(f"{k}: {op} takes a number")
    return out


LEGACY = {"market_cap": "total_mv", "pe_ratio": "pe", "pb_ratio": "pb", "eq": "==", "gt": ">", "lt": "<", "gte": ">=", "lte": "<=", "ne": "!="}


def from_legacy(node: dict) -> list[dict]:
    """A legacy tree's direct leaves as a flat list, with fields and operators renamed and market caps in the stored unit."""
    out = []
    for x in node.get("children", []):
        if "children" in x:
            continue
        v = x.get("value")
        if x["field"] == "market_cap":
            v = [y / 10000 for y in v] if isinstance(v, list | tuple) else v / 10000
        out.append({"field": LEGACY.get(x["field"], x["field"]), "operator": LEGACY.get(x["op"], x["op"]), "value": v})
    return out
