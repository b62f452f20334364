"""A partitioned table of facts by code and date: range reads, appends, predicate deletes, high-water marks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that goes when the driver ends (unset: a temporary one, in local mode only)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="alphaloom-")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def clean() -> None:
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(clean)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again, so that what follows does not compute it twice."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Store:
    """Rows of (code, dt, ...) below ``path``, one folder a month, so date ranges prune folders and codes prune row groups."""

    spark: SparkSession
    path: str
    part: str = "month"

    def append(self, df: DataFrame) -> None:
        self._write(df, "append")

    def _write(self, df: DataFrame, mode: str) -> None:
        df = df.withColumn(self.part, F.trunc("dt", "month"))
        # by ranges of month and code: a large month becomes several files of neighbouring codes
        df.repartitionByRange(self.part, "code").sortWithinPartitions(self.part, "code", "dt").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self.path)

    def read(self, start: str | None = None, end: str | None = None, codes: list | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows with start <= dt <= end of the given codes and columns; bounds left out do not bind."""
        df = self.spark.read.parquet(self.path)
        if start is not None:
            df = df.filter((F.col(self.part) >= F.trunc(F.lit(start).cast("date"), "month")) & (F.col("dt") >= F.lit(start).cast("date")))
        if end is not None:
            df = df.filter((F.col(self.part) <= F.lit(end).cast("date")) & (F.col("dt") <= F.lit(end).cast("date")))
        if codes is not None:
            df = df.filter(F.col("code").isin(codes))
        return df.select(*(columns or [c for c in df.columns if c != self.part]))

    def delete(self, gone: Column) -> None:
        """Removes the rows for which ``gone`` holds: only the months that have any are written again."""
        df = self.spark.read.parquet(self.path)
        months = df.filter(gone).select(self.part).distinct()
        # what stays is written beside the store first: a folder cannot be overwritten while it is read
        beside = scratch(self.spark, "kept")
        kept = df.join(F.broadcast(months), self.part, "left_semi").withColumn("_keep", ~F.coalesce(gone, F.lit(False)))  # a row a month
        kept.write.parquet(beside)
        kept = self.spark.read.parquet(beside)
        self._write(kept.filter("_keep").drop("_keep", self.part), "overwrite")
        left = kept.groupBy(self.part).agg(F.max("_keep").alias("any")).filter("not any").collect()  # months, few
        for row in left:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.part}={row[0]}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def watermark(self):
        """The last date held, or None."""
        return self.spark.read.parquet(self.path).agg(F.max("dt")).first()[0]


def newer(source: DataFrame, mark, end: str, days_back: int = 365) -> DataFrame:
    """Rows of ``source`` after the mark up to ``end``; without a mark, of the last ``days_back`` days."""
    last = F.lit(end).cast("date")
    first = F.lit(mark).cast("date") if mark is not None else F.date_sub(last, days_back)
    return source.filter((F.col("dt") > first) & (F.col("dt") <= last))


def freshness(tables: dict[str, DataFrame], today: str, most: int) -> DataFrame:
    """name, last (date), age in days, fresh (age at most ``most``): one row a table; an empty one is not fresh."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.max("dt").alias("last"))
        out = row if out is None else out.unionByName(row)
    age = F.datediff(F.lit(today).cast("date"), "last")
    return out.withColumn("age", age).withColumn("fresh", F.coalesce(F.col("age") <= most, F.lit(False)))
