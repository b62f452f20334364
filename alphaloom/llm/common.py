"""Helpers shared by the training-data operators: the shared scratch folder and text columns."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(col: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only in local mode (tests on one machine) may it be unset: a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="alphaloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/alphaloom-{spark.sparkContext.applicationId}"


_cleaned: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _delete_at_exit(spark: SparkSession, root: str) -> None:
    if root not in _cleaned:
        _cleaned.add(root)

        def clean() -> None:
            if spark._jsc is not None and not spark._jsc.sc().isStopped():
                _delete(spark, root)

        atexit.register(clean)


class Written:
    """A table written to the shared folder: lineage ends here, and a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame, label: str, partition_by: list[str] | None = None):
        self.spark, self.schema = df.sparkSession, df.schema
        root = shared_root(self.spark)
        _delete_at_exit(self.spark, root)
        self.path = f"{root}/{label}-{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


class Bucketed:
    """A table written once to the shared folder, hashed by ``keys`` into ``buckets`` files, each sorted by them.

    A frame that is already hashed so is written without another shuffle. Joins and groupings on
    ``keys`` read it without one.
    """

    def __init__(self, df: DataFrame, label: str, keys: list[str], buckets: int):
        self.spark = df.sparkSession
        root = shared_root(self.spark)
        _delete_at_exit(self.spark, root)
        self.name = f"{label}_{uuid.uuid4().hex}"
        self.path = f"{root}/{self.name}"
        df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", self.path).saveAsTable(self.name)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.spark, self.path)


def kept_rows(docs: DataFrame, digest: Column, verdicts: DataFrame, label: str) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (doc_id, digest, kept; one for each row) keeps, with all columns.

    Rows are told apart by doc_id (null too) and ``digest`` of their text, so a row that repeats an id
    with another text has a verdict of its own; of kept rows with equal id and digest one stays.
    """
    key = ["i", "d"]
    odd = verdicts.groupBy(F.col("doc_id").alias("gi"), F.col("digest").alias("gd")).agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = Written(odd.filter("not kept or n > 1"), label).df
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("i"), digest.alias("d"))
    same = F.col("i").eqNullSafe(F.col("gi")) & (F.col("d") == F.col("gd"))
    again = odd.filter("kept")
    if again.isEmpty():
        out = rows.join(odd, same, "left_anti")
    else:
        first = rows.join(again, same, "left_semi").groupBy(*key).agg(F.max_by("row", F.to_json("row")).alias("row"))
        out = rows.join(odd, same, "left_anti").select("row").unionByName(first.select("row"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, after which freed memory returns to the system.

    Python workers outlive their tasks, and memory that allocators keep for them counts against the
    executor in every later stage.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return wrapped
