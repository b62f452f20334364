"""Search for formulas that predict returns: a grammar of expressions, tried on blocks of dates and pruned by a bound.

Expressions form a graph: a subexpression that several formulas share is one column, computed once. Dates are
taken in blocks. After each block a formula whose mean IC can no longer reach the best ones', however the
dates left turn out (an IC is at most 1), is dropped together with the columns only it needs. So the result is that of
trying everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import correlation, rolling, series


@dataclass(frozen=True)
class Formula:
    """A column of the table (no arguments), or an operation on formulas."""

    op: str
    args: tuple["Formula", ...] = ()

    @property
    def name(self) -> str:
        return f"{self.op}({','.join(a.name for a in self.args)})" if self.args else self.op

    @property
    def depth(self) -> int:
        return 1 + max(a.depth for a in self.args) if self.args else 0


UNARY = ("rank", "delta", "mean3")
BINARY = ("sub", "mul", "div")


def grammar(columns: list[str], depth: int = 1, unary: tuple[str, ...] = UNARY, binary: tuple[str, ...] = BINARY) -> list[Formula]:
    """All formulas up to a depth; of a commutative operation one order, and no x - x, x / x."""
    level = [Formula(c) for c in columns]
    every = dict.fromkeys(level)
    for _ in range(depth):
        held = list(every)
        for op in unary:
            every |= dict.fromkeys(Formula(op, (a,)) for a in held)
        for op in binary:
            pairs = [(a, b) for i, a in enumerate(held) for j, b in enumerate(held) if (i <= j if op == "mul" else i != j if op == "div" else i < j)]
            every |= dict.fromkeys(Formula(op, p) for p in pairs)
    return list(every)


def _column(f: Formula, of: dict[Formula, str]) -> Column:
    x = [F.col(of[a]) for a in f.args]
    match f.op:
        case "rank":
            known = W.partitionBy("dt", x[0].isNull()).orderBy(x[0])
            return F.when(x[0].isNotNull(), F.percent_rank().over(known))
        case "delta":
            return x[0] - F.lag(x[0]).over(series())
        case "mean3":
            return rolling(F.avg, x[0], 3)
        case "sub":
            return x[0] - x[1]
        case "mul":
            return x[0] * x[1]
        case "div":
            return F.when(F.abs(x[1]) > 1e-12, F.try_divide(x[0], x[1]))
    raise ValueError(f.op)


def evaluate(df: DataFrame, formulas: list[Formula], keep: list[str]) -> tuple[DataFrame, dict[Formula, str]]:
    """``keep`` and a column for each formula; shared subexpressions are computed once, a level of the graph at a time."""
    needed: dict[Formula, None] = {}

    def visit(f: Formula) -> None:
        for a in f.args:
            visit(a)
        needed.setdefault(f)

    for f in formulas:
        visit(f)
    of = {f: f.op if not f.args else f"_f{i}" for i, f in enumerate(needed)}
    out = df
    for level in range(1, max((f.depth for f in needed), default=0) + 1):
        own = [f for f in needed if f.depth == level]
        out = out.withColumns({of[f]: _column(f, of) for f in own})
    return out.select(*keep, *(F.col(of[f]).cast("double").alias(f"_c{i}") for i, f in enumerate(formulas))), {f: f"_c{i}" for i, f in enumerate(formulas)}


def block_ics(df: DataFrame, formulas: list[Formula], label: str, days: DataFrame, least: int) -> dict[Formula, tuple[float, int]]:
    """Sum of daily ICs and their number over the given dates (a row a date) for each formula: a row a formula is collected."""
    wide, of = evaluate(df, formulas, ["dt", label])
    wide = wide.join(F.broadcast(days), "dt", "left_semi").filter(F.col(label).isNotNull())
    tall = wide.unpivot(["dt", label], list(of.values()), "formula", "x").filter("x is not null")
    daily = tall.groupBy("formula", "dt").agg(correlation("x", label, least).alias("ic")).filter("ic is not null")
    got = {r.formula: (r.s, r.n) for r in daily.groupBy("formula").agg(F.sum("ic").alias("s"), F.count("ic").alias("n")).collect()}
    return {f: got.get(c, (0.0, 0)) for f, c in of.items()}


def mine(df: DataFrame, formulas: list[Formula], label: str, best: int = 10, blocks: int = 4, least: int = 10) -> list[tuple[str, float, int, int]]:
    """The ``best`` formulas by absolute mean IC with the label: (name, mean IC, dates, blocks tried), best first.

    ``df`` has code, dt, the columns and the label. A date on which a formula has fewer than ``least`` values or does not vary
    counts as an IC of 0 for it. Ties go to the shorter name.
    """
    dates = df.filter(F.col(label).isNotNull()).select("dt").distinct().withColumn("block", F.ntile(blocks).over(W.orderBy("dt")))  # a row a date
    size = {r.block: r["count"] for r in dates.groupBy("block").count().collect()}
    left, all_dates = sum(size.values()), sum(size.values())
    total = {f: [0.0, 0] for f in formulas}
    alive, tried = list(formulas), dict.fromkeys(formulas, 0)
    for block in sorted(size):
        for f, (s, n) in block_ics(df, alive, label, dates.filter(F.col("block") == block).select("dt"), least).items():
            total[f][0] += s
            total[f][1] += n
            tried[f] += 1
        left -= size[block]
        # at least and at most what the absolute sum can come to
        floor = sorted((max(abs(total[f][0]) - left, 0.0) for f in alive), reverse=True)
        bar = floor[best - 1] if len(floor) >= best else 0.0
        alive = [f for f in alive if abs(total[f][0]) + left >= bar]
    ranked = sorted(alive, key=lambda f: (-round(abs(total[f][0]), 12), len(f.name), f.name))[:best]
    return [(f.name, total[f][0] / all_dates if all_dates else 0.0, total[f][1], tried[f]) for f in ranked]
