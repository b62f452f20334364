"""A factor's whole analysis in one pass: ICs at all horizons, their decay, and group returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import average_rank, correlation, series


def analyse(panel: DataFrame, factor: str, horizons: tuple[int, ...] = (1, 3, 6), groups: int = 5, least: int = 10) -> DataFrame:
    """horizon, dt, grp, n, ic, rank_ic, ret of a panel (code, dt, close, factor).

    Rows of grp null are a date's: n, ic and rank_ic over securities whose factor and return ``horizon`` rows ahead are
    known (null below ``least``), and their mean return. Rows of grp 1..``groups`` are its quantile groups': n and ret.
    The panel is dealt by code once, for the returns, and by date once; ranks, quantiles and both
    levels of sums keep that second dealing, and only sums leave it.
    """
    labels = F.array(*(F.struct(F.lit(h).alias("horizon"), F.when(F.col("close") != 0, F.try_divide(F.lead("close", h).over(series()), "close") - 1).alias("y")) for h in horizons))
    wide = panel.select("dt", F.col(factor).alias("x"), labels.alias("labels")).filter("x is not null")
    tall = wide.repartition("dt").select("dt", "x", F.inline("labels")).filter("y is not null")
    day = W.partitionBy("dt", "horizon")
    edges = F.expr(f"percentile(x, array({', '.join(str(k / groups) for k in range(1, groups))})) OVER (PARTITION BY dt, horizon)")
    tall = tall.withColumns({"_a": average_rank("x", "dt", "horizon"), "_b": average_rank("y", "dt", "horizon"), "_e": edges, "_n": F.count(F.lit(1)).over(day)})
    grp = reduce(lambda a, k: a + (F.col("x") > F.col("_e")[k]).cast("int"), range(groups - 1), F.lit(1))
    out = tall.withColumn("grp", grp).groupingSets([["horizon", "dt"], ["horizon", "dt", "grp"]], "horizon", "dt", "grp")
    whole = F.grouping("grp") == 1
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.when(whole, correlation("x", "y", least)).alias("ic"), F.when(whole, correlation("_a", "_b", least)).alias("rank_ic"), F.avg("y").alias("ret"),
    )


def report(analysis: DataFrame, groups: int = 5, lags: int = 4) -> DataFrame:
    """A row for each horizon: dates, mean_ic, std_ic, icir, positive, mean_rank_ic, nw_t, long_short, monotony, coverage.

    nw_t is the mean IC on its Newey-West error; long_short the mean over dates of the last group's return less the
    first's; monotony the correlation of a group's number with its mean return; coverage the mean number of
    securities on a date.
    """
    days = analysis.filter("grp is null")
    order, every = W.partitionBy("horizon").orderBy("dt"), W.partitionBy("horizon")  # a row a date
    known = days.filter("ic is not null").withColumn("_d", F.col("ic") - F.avg("ic").over(every))
    known = known.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(order) for k in range(1, lags + 1)})
    hac = reduce(lambda a, k: a + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)), range(1, lags + 1), F.sum(F.col("_d") * F.col("_d")))
    ics = known.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("dates"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"),
        F.avg("rank_ic").alias("mean_rank_ic"), (F.sqrt(F.greatest(hac, F.lit(0.0))) / F.count(F.lit(1))).alias("_se"),
    )
    held = analysis.filter("grp is not null")
    spread = held.groupBy("horizon", "dt").agg((F.max(F.when(F.col("grp") == groups, F.col("ret"))) - F.max(F.when(F.col("grp") == 1, F.col("ret")))).alias("ls")).groupBy("horizon").agg(F.avg("ls").alias("long_short"))
    means = held.groupBy("horizon", "grp").agg(F.avg("ret").alias("ret")).groupBy("horizon").agg(correlation("grp", "ret", 3).alias("monotony"))
    cover = days.groupBy("horizon").agg(F.avg("n").alias("coverage"))
    out = cover.join(ics, "horizon", "left").join(spread, "horizon", "left").join(means, "horizon", "left")
    return out.withColumns({"dates": F.coalesce("dates", F.lit(0)), "icir": F.when(F.col("std_ic") > 1e-12, F.try_divide("mean_ic", "std_ic")), "nw_t": F.when(F.col("_se") > 1e-15, F.try_divide("mean_ic", "_se"))}).drop("_se")
