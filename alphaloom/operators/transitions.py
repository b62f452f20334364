"""State machines over ordered rows by composing their transition maps.

What a row does to a machine of few states is a map from states to states. Maps compose, whatever the state they
begin in, so months, years and whole series are composed side by side; then each year, each month and each
row gets the state it begins with. No task walks a series: it folds a month's rows, a year's months or a
series' years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _composed(items: str, states: int) -> Column:
    """The map of all items one after another; each has the map ``f``, an array of the state that each state goes to."""
    identity = f"array({', '.join(map(str, range(states)))})"
    return F.expr(f"aggregate({items}, {identity}, (m, x) -> transform(m, s -> x.f[s]))")


def _walked(items: str, start: str) -> Column:
    """The items with ``state``, where each begins, from the state ``start`` on."""
    step = "(acc, x) -> named_struct('now', x.f[acc.now], 'out', concat(acc.out, array(named_struct('item', x, 'state', acc.now))))"
    kind = f"transform(slice({items}, 1, 0), x -> named_struct('item', x, 'state', 0))"
    return F.expr(f"aggregate({items}, named_struct('now', {start}, 'out', {kind}), {step}).out")


def states(df: DataFrame, key: str, step: Column, n: int, start: int = 0) -> DataFrame:
    """``df`` (one row for each ``key`` and dt) with ``state``, an int: where the machine is after the row.

    ``step`` is an array of n ints in 0..n-1: the state that each state goes to at the row (null: it stays). Rows
    without a date are dropped.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    stays = F.array(*(F.lit(i) for i in range(n)))
    f = F.coalesce(step, stays)
    rows = df.filter("dt is not null").select(F.col(key).alias("_key"), F.struct(F.col("dt").alias("at"), f.alias("f"), row).alias("item"), F.trunc("dt", "month").alias("_month"))
    months = rows.groupBy("_key", "_month").agg(F.array_sort(F.collect_list("item"), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)).alias("rows"))
    months = months.select("_key", F.year("_month").alias("_year"), F.struct(F.col("_month").alias("at"), _composed("rows", n).alias("f"), "rows").alias("month"))
    by_at = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    whole = months.groupBy("_key", "_year").agg(F.array_sort(F.collect_list(F.struct("month.at", "month.f")), by_at).alias("months"))
    whole = whole.select("_key", F.struct(F.col("_year").alias("at"), _composed("months", n).alias("f"), "months").alias("year"))
    series = whole.groupBy("_key").agg(F.array_sort(F.collect_list("year"), by_at).alias("years"))
    years = series.select("_key", F.explode(_walked("years", str(start))).alias("y"))
    begun = years.select("_key", F.explode(_walked("y.item.months", "y.state")).alias("m")).select("_key", F.col("m.item.at").alias("_at"), F.col("m.state").alias("_begin"))
    both = months.join(begun, months["_key"].eqNullSafe(begun["_key"]) & (F.col("month.at") == F.col("_at"))).select("month", "_begin")
    out = both.select(F.explode(_walked("month.rows", "_begin")).alias("r"))
    return out.select("r.item.row.*", F.expr("r.item.f[r.state]").alias("state"))
