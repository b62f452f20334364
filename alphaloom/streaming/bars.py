"""Streams of events: windowed bars with late data bounded by a watermark, and an upsert sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.sources.tables import upsert


def windowed_bars(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """code, start, high, low, volume, amount per user and window; events later than ``late`` are left out."""
    windowed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), F.col("user_id").alias("code"))
    out = windowed.agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count(F.lit(1)).alias("volume"), F.sum("value").alias("amount"))
    return out.select("code", F.col("w.start").alias("start"), "high", "low", "volume", "amount")


def upsert_sink(path: str, keys: list[str], order: str):
    """A foreachBatch function that keeps, of rows with equal keys, the last; each batch writes a new version beside the old one."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{epoch - 1}") if epoch else batch.limit(0)
        upsert(old, batch, keys, order).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return write
