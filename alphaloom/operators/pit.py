"""Point-in-time reads: what was known on a date, without look-ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def known_at(filings: DataFrame, day: str) -> DataFrame:
    """Per code and period, the best report announced by ``day``: by source priority, revision, then announcement."""
    best = W.partitionBy("code", "end_date").orderBy(F.col("source_priority").desc(), F.col("revision_no").desc(), F.col("ann_date").desc())
    return filings.filter(F.col("ann_date") <= F.lit(day).cast("date")).withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def latest_at(filings: DataFrame, day: str) -> DataFrame:
    """Per code, the latest period known at ``day``."""
    last = W.partitionBy("code").orderBy(F.col("end_date").desc())
    return known_at(filings, day).withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")


def as_of(left: DataFrame, right: DataFrame, value: str, period: str = "end_date", rank: tuple[str, ...] = ("source_priority", "revision_no"), order: str = "ann_date") -> DataFrame:
    """``left`` (code, dt) with the ``value`` of the latest period of ``right`` that is announced (``order``) by dt, in its best version by ``rank``.

    Both sides are stacked and swept once per code, so the cost is a sort and no join multiplies rows;
    right rows of the same day come first. A late restatement of an old period replaces no newer one.
    """
    best = F.struct(F.col(period).alias("p"), *(F.col(c).alias(f"r{i}") for i, c in enumerate(rank)), F.col(value).alias("v"))
    facts = right.select("code", F.col(order).alias("dt"), F.lit(0).alias("_side"), best.alias("_v"))
    rows = left.select("code", "dt", F.lit(1).alias("_side"), F.lit(None).cast(facts.schema["_v"].dataType).alias("_v"))
    sweep = W.partitionBy("code").orderBy("dt", "_side").rowsBetween(W.unboundedPreceding, 0)
    out = rows.unionByName(facts).withColumn("_b", F.max("_v").over(sweep))
    return out.filter("_side = 1").select("code", "dt", F.col("_b.v").alias(value))


def growth(filings: DataFrame, value: str, lag: int = 4) -> DataFrame:
    """(x - x[-lag]) / |x[-lag]| over a code's periods, and the mean and deviation of the last eight."""
    w = W.partitionBy("code").orderBy("end_date")
    before = F.lag(value, lag).over(w)
    eight = w.rowsBetween(-7, 0)
    return filings.withColumns({
        "yoy": F.when(F.abs(before) >= 1e-8, (F.col(value) - before) / F.abs(before)),
        "stability": F.when(F.count(value).over(eight) >= 4, 1 / (1 + F.least(F.lit(10.0), F.stddev_samp(value).over(eight) / F.abs(F.avg(value).over(eight))))),
    })
