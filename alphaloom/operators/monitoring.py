"""Watching portfolios: exposures, crowding and turnover of models, daily risk limits, and rebalancing by deviation.

Holdings are rows (model, dt, code, weight), one row a model, date and code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def held_exposures(holdings: DataFrame, members: DataFrame, factors: DataFrame) -> DataFrame:
    """model, dt, kind, name, exposure: weight by industry, and the sum of weight times value by factor.

    ``members``: code, industry (a code without one counts as ``other``). ``factors``: dt, code, factor, x; null values
    count for nothing, and a factor without any known value is absent.
    """
    by_industry = holdings.join(members.select("code", "industry"), "code", "left")
    industry = by_industry.groupBy("model", "dt", F.coalesce(F.col("industry").cast("string"), F.lit("other")).alias("name")).agg(F.sum("weight").alias("exposure"))
    known = factors.filter("x is not null").select("dt", "code", "factor", "x")
    style = holdings.join(known, ["dt", "code"]).groupBy("model", "dt", F.col("factor").alias("name")).agg(F.sum(F.col("weight") * F.col("x")).alias("exposure"))
    columns = ["model", "dt", "kind", "name", "exposure"]
    return industry.withColumn("kind", F.lit("industry")).select(*columns).unionByName(style.withColumn("kind", F.lit("style")).select(*columns))


def crowding(holdings: DataFrame) -> DataFrame:
    """model, dt, held, shared, crowding, turnover.

    ``shared`` counts the codes that another model holds on the same date, ``crowding`` is its share of ``held``.
    ``turnover`` is half the sum of weight changes since the model's date before (null on its first).
    """
    others = F.count(F.lit(1)).over(W.partitionBy("dt", "code")) > 1
    rows = holdings.select("model", "dt", "code", "weight", others.alias("shared"))
    size = rows.groupBy("model", "dt").agg(F.count(F.lit(1)).alias("held"), F.count_if("shared").alias("shared"))
    size = size.withColumn("_next", F.lead("dt").over(W.partitionBy("model").orderBy("dt")))
    size = size.withColumn("_first", F.lag("dt").over(W.partitionBy("model").orderBy("dt")).isNull())
    gone = holdings.join(size.select("model", "dt", "_next"), ["model", "dt"]).filter("_next is not null").select("model", F.col("_next").alias("dt"), "code", (-F.col("weight")).alias("weight"))
    moved = holdings.select("model", "dt", "code", "weight").unionByName(gone).groupBy("model", "dt", "code").agg(F.abs(F.sum("weight")).alias("_m")).groupBy("model", "dt").agg((F.sum("_m") / 2).alias("_t"))
    out = size.join(moved, ["model", "dt"])
    return out.select("model", "dt", "held", "shared", (F.col("shared") / F.col("held")).alias("crowding"), F.when(~F.col("_first"), F.col("_t")).alias("turnover"))


@dataclass(frozen=True)
class Limits:
    """Largest weight, value at risk, mean loss beyond it and drawdown that raise no alert."""

    weight: float = 0.05
    var: float = 0.02
    cvar: float = 0.03
    drawdown: float = 0.10


def risk_report(holdings: DataFrame, returns: DataFrame, lookback: int = 60, least: int = 21, confidence: float = 0.95) -> DataFrame:
    """model, dt, days, max_weight, var, cvar, drawdown of each model's holdings over the ``lookback`` dates up to dt.

    ``returns``: dt, code, ret. The weights of dt are held over all earlier dates; a code without a return has 0 on
    dates on which another held code has one. Losses are positive numbers, ``drawdown`` is the deepest fall (0 or
    below). Below ``least`` dates they are null. A holding is spelled out into its ``lookback`` dates, so the join is
    on (date number, code).
    """
    known = returns.filter("ret is not null").select("dt", "code", "ret")
    days = known.select("dt").unionByName(holdings.select("dt")).distinct().withColumn("day", F.row_number().over(W.orderBy("dt")))  # one row a date
    past = known.join(days, "dt").select("day", "code", "ret")
    held = holdings.join(days, "dt")
    spelled = held.select("model", "dt", "code", "weight", F.explode(F.sequence(F.col("day") - lookback + 1, F.col("day"))).alias("day"))
    daily = spelled.join(past, ["day", "code"]).groupBy("model", "dt", "day").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    one = W.partitionBy("model", "dt")
    up_to = one.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    nav = daily.withColumn("nav", F.product(1 + F.col("r")).over(up_to)).withColumn("fall", F.try_divide("nav", F.max("nav").over(up_to)) - 1)
    cut = nav.groupBy("model", "dt").agg(F.percentile("r", 1 - confidence).alias("q"))
    tail = nav.join(cut, ["model", "dt"]).groupBy("model", "dt").agg(
        F.count(F.lit(1)).alias("days"), (-F.first("q")).alias("var"), (-F.avg(F.when(F.col("r") <= F.col("q"), F.col("r")))).alias("cvar"), F.min("fall").alias("drawdown"))
    size = holdings.groupBy("model", "dt").agg(F.max("weight").alias("max_weight"))
    out = size.join(tail, ["model", "dt"], "left").withColumn("days", F.coalesce("days", F.lit(0)))
    enough = F.col("days") >= least
    return out.select("model", "dt", "days", "max_weight", *(F.when(enough, F.col(c)).alias(c) for c in ("var", "cvar", "drawdown")))


def risk_alerts(report: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """model, dt, alert, severity, value, bound: one row for each limit that a row of ``risk_report`` breaks."""
    rules = [("concentration", "high", "max_weight", limits.weight), ("var_breach", "high", "var", limits.var), ("cvar_breach", "critical", "cvar", limits.cvar), ("drawdown_breach", "critical", "drawdown", -limits.drawdown)]
    each = F.array(*(F.struct(F.lit(name).alias("alert"), F.lit(level).alias("severity"), F.col(x).alias("value"), F.lit(float(bound)).alias("bound")) for name, level, x, bound in rules))
    broken = "(alert = 'drawdown_breach' and value < bound) or (alert <> 'drawdown_breach' and value > bound)"
    return report.select("model", "dt", F.explode(each).alias("a")).select("model", "dt", "a.*").filter(broken)


def rebalance_by_deviation(targets: DataFrame, threshold: float = 0.02, least: int = 10, block: int = 16) -> DataFrame:
    """dt, since, deviation, rebalance: when a portfolio follows its targets (dt, code, weight).

    Targets of ``since`` are held until a date at least ``least`` dates later whose targets differ by more than
    ``threshold`` (root of the sum of squares over the codes of both), or share no code. The first date always
    rebalances; a null deviation means no common code.

    For every date the next one that would rebalance is sought among ``block`` dates at a time, and only dates
    without one go on to the next block; so no bound is set on how long a portfolio is held. What reaches the driver
    is one pair of numbers a date, the calendar.
    """
    spark = targets.sparkSession
    days = targets.select("dt").filter("dt is not null").distinct().withColumn("i", F.row_number().over(W.orderBy("dt")) - 1)  # one row a date
    held = targets.join(days, "dt").select("i", "code", "weight")
    last = days.agg(F.max("i")).first()[0]
    if last is None:
        return targets.select("dt", F.col("dt").alias("since"), F.lit(0.0).alias("deviation"), F.lit(True).alias("rebalance")).limit(0)
    following: dict[int, int] = {}
    begin, left = least, list(range(last + 1))
    while left := [a for a in left if a not in following and a + begin <= last]:
        pairs = spark.createDataFrame([(a,) for a in left], "a int").select("a", F.explode(F.sequence(F.col("a") + begin, F.least(F.col("a") + begin + block - 1, F.lit(last)))).alias("b"))
        far = _deviation(pairs, held).filter(F.col("deviation").isNull() | (F.col("deviation") > threshold))
        following |= {r.a: r.b for r in far.groupBy("a").agg(F.min("b").alias("b")).collect()}
        begin += block
    since, chain, due = 0, [], 0
    for i in range(last + 1):
        if i == due:
            since, before = i, since
            chain.append((i, before, True))
            due = following.get(i, -1)
        else:
            chain.append((i, since, False))
    pairs = spark.createDataFrame([(a, b) for b, a, _ in chain], "a int, b int")
    flags = spark.createDataFrame(chain, "i int, since_i int, rebalance boolean")
    far = _deviation(pairs, held).select(F.col("b").alias("i"), "deviation")
    first = days.select(F.col("i").alias("since_i"), F.col("dt").alias("since"))
    return days.join(flags, "i").join(far, "i").join(first, "since_i").select("dt", "since", "deviation", "rebalance")


def _deviation(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """a, b, deviation of the targets of dates a and b over their common codes (null: none)."""
    x = pairs.join(held.select(F.col("i").alias("a"), "code", F.col("weight").alias("_x")), "a")
    both = x.join(held.select(F.col("i").alias("b"), "code", F.col("weight").alias("_y")), ["b", "code"])
    size = both.groupBy("a", "b").agg(F.sqrt(F.sum((F.col("_x") - F.col("_y")) ** 2)).alias("deviation"))
    return pairs.join(size, ["a", "b"], "left")
