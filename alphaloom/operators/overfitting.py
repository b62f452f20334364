"""Probability that the best of many strategies is overfitted, by combinatorially symmetric cross-validation.

Dates are cut into an even number of blocks, and every half of the blocks is in-sample once. A strategy's
Sharpe ratios on both halves come from its blocks' counts, sums and sums of squares, so returns are read
once and no split touches them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import average_rank

MOST_BLOCKS = 16  # 12,870 splits


def block_moments(returns: DataFrame, blocks: int = 8) -> DataFrame:
    """strategy, block, n, s, ss of known returns (strategy, dt, ret); blocks hold equally many dates (one row a date is numbered)."""
    known = returns.filter("ret is not null and dt is not null")
    dates = known.select("dt").distinct().withColumn("block", F.ntile(blocks).over(W.orderBy("dt")) - 1)
    return known.join(F.broadcast(dates), "dt").groupBy("strategy", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("ss"))


def _sharpe(side: str):
    n, s, ss = (F.col(f"{side}_{x}") for x in ("n", "s", "ss"))
    var = (ss - s * s / n) / (n - 1)
    return F.when((n > 1) & (var > 1e-18), s / n / F.sqrt(var))


def split_sharpes(moments: DataFrame, blocks: int = 8) -> DataFrame:
    """split (bit mask of in-sample blocks), strategy, inside, outside: Sharpe ratios on both halves (null: no variance)."""
    if blocks % 2 or not 2 <= blocks <= MOST_BLOCKS:
        raise ValueError(f"blocks must be even and at most {MOST_BLOCKS}")
    spark = moments.sparkSession
    splits = spark.range(1 << blocks, numPartitions=1).toDF("split").filter(F.bit_count("split") == blocks // 2)
    mask = F.expr("shiftright(split, CAST(block AS INT)) & 1 = 1")
    met = moments.crossJoin(F.broadcast(splits))  # a fixed number of splits
    sums = {f"{side}_{x}": F.sum(F.when(mask if side == "i" else ~mask, F.col(x)).otherwise(0)) for side in "io" for x in ("n", "s", "ss")}
    per = met.groupBy("split", "strategy").agg(*(v.alias(k) for k, v in sums.items()))
    return per.select("split", "strategy", _sharpe("i").alias("inside"), _sharpe("o").alias("outside"))


def best_of_splits(sharpes: DataFrame) -> DataFrame:
    """split, strategy, inside, outside, omega, logit: of each split the best strategy in-sample and its relative rank out of sample.

    Ties go to the smaller strategy. omega is rank / (strategies + 1); logit its log odds, at most 0 where the best
    is no better than the median out of sample. Strategies without a ratio on either half are not ranked.
    """
    known = sharpes.filter("inside is not null and outside is not null")
    by = W.partitionBy("split")
    ranked = known.withColumns({"_rank": average_rank("outside", "split"), "_count": F.count(F.lit(1)).over(by), "_best": F.row_number().over(by.orderBy(F.desc("inside"), "strategy"))})
    omega = F.col("_rank") / (F.col("_count") + 1)
    return ranked.filter("_best = 1").select("split", "strategy", "inside", "outside", omega.alias("omega"), F.ln(omega / (1 - omega)).alias("logit"))


def overfitting(returns: DataFrame, blocks: int = 8) -> DataFrame:
    """One row: splits, pbo (share of splits with logit <= 0), loss (share with a negative ratio out of sample), slope and intercept of outside on inside, mean_logit."""
    best = best_of_splits(split_sharpes(block_moments(returns, blocks), blocks))
    varies = F.var_samp("inside") > 1e-18
    slope = F.when(varies, F.covar_samp("inside", "outside") / F.var_samp("inside"))
    return best.agg(
        F.count(F.lit(1)).alias("splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg((F.col("outside") < 0).cast("double")).alias("loss"),
        slope.alias("slope"), (F.avg("outside") - slope * F.avg("inside")).alias("intercept"), F.avg("logit").alias("mean_logit"),
    )
