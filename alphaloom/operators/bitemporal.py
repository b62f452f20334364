"""Statements on two time axes: when they hold (valid time) and since when they are known (knowledge time).

A report says from ``known`` on that its values hold on the days from ``start`` up to but not including ``end`` (null:
for good). A later report replaces an earlier one on the days that both cover, and there alone. The table of
rectangles has, for each piece of valid time, the interval of knowledge in which a report is the latest word; the
rectangles of a code do not overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def _pieces(reports: DataFrame, order: str) -> DataFrame:
    """Reports cut at every bound of their code: code, from, to, known, ``order`` and ``row`` (all columns of the report).

    Of reports known on one day about one piece the one of the highest ``order`` stays. Reports without code,
    start or known, or whose end is not after their start, say nothing.
    """
    end = F.coalesce("end", F.lit(FOREVER).cast("date"))
    row = F.struct(*(F.col(f"`{c}`") for c in reports.columns))
    held = reports.select("code", "start", end.alias("end"), "known", F.col(order).alias("_order"), row.alias("row")).filter("code is not null and known is not null and start < end")
    days = held.select("code", F.explode(F.array("start", "end")).alias("day"))
    bounds = days.groupBy("code").agg(F.array_sort(F.collect_set("day")).alias("bounds"))  # the dates of one code
    cut = held.join(bounds, "code").withColumn("from", F.explode(F.expr("filter(bounds, b -> b >= start and b < end)")))
    cut = cut.withColumn("to", F.expr("filter(bounds, b -> b > `from`)[0]"))
    last = F.row_number().over(W.partitionBy("code", "from", "known").orderBy(F.col("_order").desc_nulls_last(), F.xxhash64("row").desc()))
    return cut.withColumn("_rn", last).filter("_rn = 1").select("code", "from", "to", "known", "_order", "row")


def rectangles(reports: DataFrame, order: str = "revision") -> DataFrame:
    """All columns of the reports, and valid_from, valid_to, known_from, known_to (null: until further notice).

    Reports have code, start, end, known (dates) and ``order``, which decides between reports of one day. Neighbouring
    pieces of one report with the same knowledge interval are one rectangle again.
    """
    piece = W.partitionBy("code", "from").orderBy("known")
    known = _pieces(reports, order).withColumn("known_to", F.lead("known").over(piece)).withColumn("_row", F.xxhash64("row"))
    same = W.partitionBy("code", "_row", "known", "known_to").orderBy("from")
    fresh = F.coalesce((F.lag("to").over(same) != F.col("from")).cast("int"), F.lit(1))
    island = known.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(same))
    out = island.groupBy("code", "_row", "known", "known_to", "_island").agg(F.min("from").alias("valid_from"), F.max("to").alias("valid_to"), F.any_value("row").alias("row"))
    until = F.when(F.col("valid_to") < F.lit(FOREVER).cast("date"), F.col("valid_to"))
    return out.select("row.*", "valid_from", until.alias("valid_to"), F.col("known").alias("known_from"), "known_to")


def as_of_both(reports: DataFrame, asked: DataFrame, order: str = "revision") -> DataFrame:
    """``asked`` (code, valid_at, known_at and other columns) with ``report``: what was known at known_at about valid_at, or null.

    Two sweeps over one partitioning by code: the first finds the piece of valid time for each question, the second
    the latest report about that piece. No question meets more than its piece, so nothing multiplies.
    """
    cut = _pieces(reports, order)
    question = F.struct(*(F.col(f"`{c}`") for c in asked.columns)).alias("question")
    edges = cut.select("code", F.col("from").alias("day"), F.struct("from", "to").alias("piece")).distinct()
    asks = asked.select("code", F.col("valid_at").alias("day"), F.col("known_at").alias("known"), question)
    both = edges.withColumns({"known": F.lit(None).cast("date"), "question": F.lit(None).cast(asks.schema["question"].dataType)}).unionByName(asks.withColumn("piece", F.lit(None).cast(edges.schema["piece"].dataType)))
    by_day = W.partitionBy("code").orderBy("day", F.col("question").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("piece", F.last("piece", ignorenulls=True).over(by_day)).filter("question is not null")
    start = F.when(F.col("day") < F.col("piece.to"), F.col("piece.from"))
    found = found.select("code", start.alias("from"), "known", "question", F.lit(None).cast(cut.schema["row"].dataType).alias("row"))
    both = cut.select("code", "from", "known", F.lit(None).cast(found.schema["question"].dataType).alias("question"), "row").unionByName(found)
    by_known = W.partitionBy("code", "from").orderBy("known", F.col("question").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("report", F.last("row", ignorenulls=True).over(by_known)).filter("question is not null")
    # questions whose day is in no piece share a window without reports; those that know no date know nothing
    return out.select("question.*", F.when(F.col("from").isNotNull() & F.col("known").isNotNull(), F.col("report")).alias("report"))
