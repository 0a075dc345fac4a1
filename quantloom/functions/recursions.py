"""Recursive series as native folds: first-order recurrences over a symbol's bars, in order of ``trade_date``.

A state follows ``state = step(state, x)``, affine in the state; a null ``x`` holds it, a ``seed`` sets it anew. A
symbol's bars are cut into chunks of CHUNK bars. Since steps are affine, a chunk as a whole maps the state before it
to the one after it as p * state + q, which one fold over the chunk finds without knowing the state. A fold over these
pairs, one for each chunk before, gives each chunk its start, and a second fold over the chunk gives the state at every
bar. Any number of recursions share both folds. So arrays hold CHUNK bars, or a pair for each CHUNK bars, and a symbol
of any length is spread over as many rows as it has chunks. All steps keep the partitioning by symbol: a scan, and
windows before and after it, plan one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as w

CHUNK = 1024


class Term:
    """An expression as SQL text, put together by arithmetic. Folds of many recursions are one text each, which is parsed at once."""

    def __init__(self, text: str) -> None:
        self.text = text

    @staticmethod
    def of(x: Term | float | int) -> str:
        return x.text if isinstance(x, Term) else f"{x!r}D" if isinstance(x, float) else str(x)

    def __add__(self, x): return Term(f"({self.text} + {Term.of(x)})")  # noqa: E704
    def __radd__(self, x): return Term(f"({Term.of(x)} + {self.text})")  # noqa: E704
    def __sub__(self, x): return Term(f"({self.text} - {Term.of(x)})")  # noqa: E704
    def __mul__(self, x): return Term(f"({self.text} * {Term.of(x)})")  # noqa: E704
    def __rmul__(self, x): return Term(f"({Term.of(x)} * {self.text})")  # noqa: E704
    def __truediv__(self, x): return Term(f"({self.text} / {Term.of(x)})")  # noqa: E704


Step = Callable[[Term, Term], Term]


@dataclass(frozen=True)
class Recursion:
    """``x``, ``seed``: columns of the bars. ``step``: arithmetic on the state and ``x``. ``keep``: the factor of the state in it. ``initial``: the state before the first bar."""

    x: str
    step: Step
    keep: float
    seed: str | None = None
    initial: float | None = None


def scan(df: DataFrame, recursions: dict[str, Recursion], chunk: int = CHUNK) -> DataFrame:
    """``df`` and, by name, the state after each bar (double). Rows of one date follow each other in any order."""
    if not recursions:
        return df
    names, rs = list(recursions), list(recursions.values())
    rest = [c for c in df.columns if c != "symbol"]
    numbered = df.withColumn("__place", F.row_number().over(w.by_symbol()) - 1)
    rows = F.expr("sort_array(collect_list(struct(__place, " + ", ".join(f"`{c}`" for c in rest) + ")))")
    parts = numbered.groupBy("symbol", F.floor(F.col("__place") / chunk).alias("__chunk")).agg(rows.alias("__rows"))

    value = lambda name: f"CAST(r.`{name}` AS DOUBLE)"
    struct = lambda fields: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    number = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"{float(v)!r}D"
    held = lambda r, state, moved: f"CASE WHEN {value(r.x)} IS NULL THEN {state} ELSE {moved} END"
    stepped = lambda r, state: held(r, state, r.step(Term(state), Term(value(r.x))).text)

    def whole(k: int, r: Recursion) -> dict[str, str]:
        """p, q and whether a seed came, of a chunk's bars so far."""
        p, q = held(r, f"acc.p{k}", f"acc.p{k} * {r.keep!r}D"), stepped(r, f"acc.q{k}")
        if r.seed is None:
            return {f"p{k}": p, f"q{k}": q, f"s{k}": "false"}
        seed = value(r.seed)
        return {f"p{k}": f"CASE WHEN {seed} IS NOT NULL THEN 0D ELSE {p} END", f"q{k}": f"coalesce({seed}, {q})", f"s{k}": f"acc.s{k} OR {seed} IS NOT NULL"}

    each = lambda f: struct({name: v for k, r in enumerate(rs) for name, v in f(k, r).items()})
    nothing = each(lambda k, r: {f"p{k}": "1D", f"q{k}": "0D", f"s{k}": "false"})
    parts = parts.withColumn("__map", F.expr(f"aggregate(__rows, {nothing}, (acc, r) -> {each(whole)})"))
    earlier = Window.partitionBy("symbol").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__maps", F.collect_list("__map").over(earlier))
    # A chunk that seeds the state forgets the one before; otherwise a null state stays null.
    carried = each(lambda k, r: {f"v{k}": f"CASE WHEN m.s{k} THEN m.q{k} ELSE m.p{k} * acc.v{k} + m.q{k} END"})
    start = each(lambda k, r: {f"v{k}": number(r.initial)})
    parts = parts.withColumn("__start", F.expr(f"aggregate(__maps, {start}, (acc, m) -> {carried})"))

    new = each(lambda k, r: {f"v{k}": stepped(r, f"acc.at.v{k}") if r.seed is None else f"coalesce({value(r.seed)}, {stepped(r, f'acc.at.v{k}')})"})
    kind = "array<struct<" + ",".join(f"v{k}:double" for k in range(len(rs))) + ">>"
    run = f"aggregate(__rows, named_struct('at', __start, 'all', CAST(array() AS {kind})), (acc, r) -> named_struct('at', {new}, 'all', concat(acc.all, array(acc.at))))"
    # The fold collects the state before each bar; shifted by one, with the last state behind, it is the state after it.
    run = parts.select("symbol", "__rows", F.expr(run).alias("r"))
    states = run.selectExpr("symbol", "__rows", "concat(slice(r.all, 2, size(__rows)), array(r.at)) AS __states")
    flat = states.selectExpr("symbol", "inline(arrays_zip(__rows, __states))")
    return flat.selectExpr(*["symbol" if c == "symbol" else f"__rows.`{c}`" for c in df.columns], *[f"__states.v{k} AS `{n}`" for k, n in enumerate(names)])


def blend(n: float) -> Step:
    """Exponential mean of span n: alpha = 2 / (n + 1)."""
    return by_alpha(2 / (n + 1))


def by_alpha(alpha: float) -> Step:
    return lambda s, x: alpha * x + (1 - alpha) * s


def wilder(n: int) -> Step:
    return lambda s, x: (s * (n - 1) + x) / n


def decayed(keep: float) -> Step:
    """Sum in which each bar weighs ``keep`` times the next one."""
    return lambda s, x: s * keep + x
