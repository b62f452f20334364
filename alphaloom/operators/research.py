"""Labels and factor research: forward returns, information coefficients, groups, drift."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import average_rank, correlation, date, series


def forward_returns(df: DataFrame, horizons: tuple[int, ...] = (1,)) -> DataFrame:
    """fwd_{h} = close[+h] / close - 1 over one window."""
    return df.withColumns({f"fwd_{h}": F.when(F.col("close") != 0, F.lead("close", h).over(series()) / F.col("close") - 1) for h in horizons})


def excess_return(df: DataFrame, h: int = 1) -> DataFrame:
    """Forward return less the mean of the date."""
    return forward_returns(df, (h,)).withColumn("excess", F.col(f"fwd_{h}") - F.avg(f"fwd_{h}").over(date()))


def industry_neutral_return(df: DataFrame, h: int = 1) -> DataFrame:
    return forward_returns(df, (h,)).withColumn("neutral", F.col(f"fwd_{h}") - F.avg(f"fwd_{h}").over(date("dt", "industry")))


def ic_series(df: DataFrame, factor: str, label: str, least: int = 10) -> DataFrame:
    """Per date: n, Pearson IC and rank IC of factor and label over rows where both are known."""
    df = df.filter(F.col(factor).isNotNull() & F.col(label).isNotNull()).select("dt", factor, label)
    df = df.withColumns({"_a": average_rank(factor), "_b": average_rank(label)})
    return df.groupBy("dt").agg(F.count(F.lit(1)).alias("n"), correlation(factor, label, least).alias("ic"), correlation("_a", "_b", least).alias("rank_ic")).filter(F.col("n") >= least)


def ic_statistics(ic: DataFrame, lags: int = 4) -> DataFrame:
    """Mean, std, positive share, ICIR, and the Newey-West standard error (Bartlett weights) of an IC series."""
    order = W.orderBy("dt")  # one row a date
    df = ic.filter("ic is not null").withColumn("_d", F.col("ic") - F.avg("ic").over(W.partitionBy()))
    df = df.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(order) for k in range(1, lags + 1)})
    hac = reduce(lambda a, k: a + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)), range(1, lags + 1), F.sum(F.col("_d") * F.col("_d")))
    n = F.count(F.lit(1))
    out = df.agg(n.alias("n"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.sqrt(F.greatest(hac, F.lit(0.0))) / n)
    out = out.toDF("n", "mean_ic", "std_ic", "positive", "nw_se")
    return out.withColumns({"icir": F.when(F.col("std_ic") > 0, F.col("mean_ic") / F.col("std_ic")), "nw_t": F.when(F.col("nw_se") > 0, F.col("mean_ic") / F.col("nw_se"))})


def decay(df: DataFrame, factor: str, most: int = 6) -> DataFrame:
    """Mean IC of the factor with one-step returns 1 to ``most`` steps ahead: lag, ic, dates."""
    df = forward_returns(df, (1,))
    ahead = df.withColumns({f"_l{k}": F.lead("fwd_1", k - 1).over(series()) for k in range(1, most + 1)})
    tall = ahead.select("dt", F.col(factor).alias("f"), F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("r")) for k in range(1, most + 1)))).alias("x")).select("dt", "f", "x.*")
    per_date = tall.groupBy("lag", "dt").agg(correlation("f", "r", 10).alias("ic"))
    return per_date.filter("ic is not null").groupBy("lag").agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("dates"))


def quantile_groups(df: DataFrame, factor: str, n: int = 5) -> DataFrame:
    """Group 1..n of each row by its date's interpolated quantiles (right-closed; null factor: null)."""
    edges = F.expr(f"percentile({factor}, array({', '.join(str(k / n) for k in range(1, n))})) OVER (PARTITION BY dt)")
    df = df.withColumn("_e", edges)
    above = reduce(lambda a, k: a + (F.col(factor) > F.col("_e")[k]).cast("int"), range(n - 1), F.lit(1))
    return df.withColumn("grp", F.when(F.col(factor).isNotNull(), above)).drop("_e")


def group_returns(df: DataFrame, factor: str, label: str, n: int = 5) -> DataFrame:
    """Mean label per date and group."""
    df = quantile_groups(df.filter(F.col(factor).isNotNull() & F.col(label).isNotNull()), factor, n)
    return df.groupBy("dt", "grp").agg(F.avg(label).alias("ret"), F.count(F.lit(1)).alias("n"))


def factor_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(correlation(a, b, 2).alias("pearson"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"))


def _place(x: str, edges: str) -> Column:
    """How many edges a value exceeds."""
    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + (F.col(x) > e).cast("int"))


def psi(reference: DataFrame, current: DataFrame, x: str, bins: int = 10, accuracy: int = 100_000, equal_width: bool = False) -> DataFrame:
    """Population stability index, empty shares as 1e-4: one row.

    Bins are the reference's quantiles (values whose rank is within one in ``accuracy``, from a mergeable
    sketch), or of equal width over its range.
    """
    if equal_width:
        low, high = F.min(x), F.max(x)
        edges = reference.agg(F.array(*(low + (high - low) * (k / bins) for k in range(1, bins))).alias("_e"))
    else:
        edges = reference.agg(F.percentile_approx(x, [k / bins for k in range(1, bins)], accuracy).alias("_e"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        df = df.filter(F.col(x).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", _place(x, "_e"))  # one row of edges
        counted = df.groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
        return counted.select("bin", (F.col("c") / F.sum("c").over(W.partitionBy())).alias(name))

    both = shares(reference, "p").join(shares(current, "q"), "bin", "full_outer")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-4)) for c in ("p", "q"))
    return both.agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def ks(a: DataFrame, b: DataFrame, x: str, parts: int = 64) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic: one row.

    Counts per distinct value are summed within ranges of values first, so no task orders all rows. The
    ranges are cut at sketched quantiles, collected as ``parts`` - 1 numbers: a range is told by the
    value alone, and any task that is run again finds the same.
    """
    both = a.select(x, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(x, F.lit(0).alias("_a"), F.lit(1).alias("_b"))).filter(F.col(x).isNotNull())
    cuts = sorted(set(both.agg(F.percentile_approx(x, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []))
    both = both.withColumn("_cuts", F.lit(cuts).cast("array<double>"))
    counts = both.groupBy(_place(x, "_cuts").alias("_part"), x).agg(F.sum("_a").alias("ca"), F.sum("_b").alias("cb"))
    sizes = counts.groupBy("_part").agg(F.sum("ca").alias("pa"), F.sum("cb").alias("pb"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumns({"ba": F.coalesce(F.sum("pa").over(before), F.lit(0)), "bb": F.coalesce(F.sum("pb").over(before), F.lit(0)), "na": F.sum("pa").over(W.partitionBy()), "nb": F.sum("pb").over(W.partitionBy())})
    inside = W.partitionBy("_part").orderBy(x)
    steps = counts.withColumns({"sa": F.sum("ca").over(inside), "sb": F.sum("cb").over(inside)}).join(F.broadcast(sizes), "_part")  # at most ``parts`` rows
    return steps.agg(F.max(F.abs((F.col("ba") + F.col("sa")) / F.col("na") - (F.col("bb") + F.col("sb")) / F.col("nb"))).alias("ks"))


def style_adjusted(df: DataFrame, label: str, styles: list[str]) -> DataFrame:
    """code, dt, residual of the label on styles per date (too few rows: the label)."""
    from .preprocess import residual

    return residual(df, label, styles, max(3 * (len(styles) + 1), len(styles) + 11))


def half_life(ic: DataFrame) -> DataFrame:
    """Half-life of a decay table (lag, mean_ic) by least squares of ln|ic| on lag: one row, null without decay."""

    size = F.when(F.abs("mean_ic") > 1e-12, F.abs("mean_ic"))
    slope = F.regr_slope(F.ln(size), F.when(size.isNotNull(), F.col("lag").cast("double")))
    return ic.agg(slope.alias("_s")).select(F.when(F.col("_s") < 0, F.lit(np.log(2)) / -F.col("_s")).alias("half_life"))


def drift(ic: DataFrame, recent: int = 12) -> DataFrame:
    """Mean of the last ``recent`` ICs less the mean of all: one row."""
    ic = ic.filter("ic is not null").withColumn("_rn", F.row_number().over(W.orderBy(F.col("dt").desc())))  # one row a date
    short = F.avg(F.when(F.col("_rn") <= recent, F.col("ic")))
    return ic.agg(short.alias("recent"), F.avg("ic").alias("overall")).withColumn("drift", F.col("recent") - F.col("overall"))


def rolling_ic(ic: DataFrame, n: int = 12, least: int = 6) -> DataFrame:
    w = W.orderBy("dt").rowsBetween(-(n - 1), 0)  # one row a date
    return ic.withColumn("rolling_ic", F.when(F.count("rank_ic").over(w) >= least, F.avg("rank_ic").over(w)))
