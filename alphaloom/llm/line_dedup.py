"""Line dedup over levelled sorted runs of line hashes.

The index is a log-structured merge tree on the shared folder. A run is a table of
(hash, owner), sorted by hash, in which each hash occurs once; a hash lives in one run only. A new
batch is merge-anti-joined with all runs, what is new becomes a run of level 0, and ``fanout`` runs
of a level are compacted into one of the next. Batches arrive in ascending doc_id, so the first
owner of a line is its smallest doc_id and never changes.

A run is bucketed by its hashes into as many files as a shuffle has partitions, each of them sorted:
only a batch is shuffled, runs meet it, each other and the lines as they lie on disk, without an
exchange or a sort.

A hash has 128 bits (two 64-bit hashes of different seeds). Lines are 28 bytes while they are
shuffled; texts are shuffled once, to meet the positions of their dropped lines. Lines that very many
documents hold are not shuffled: a sketch finds them and their few owners are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, UPPER, Bucketed, Written, ascii_lower, text_of

HASH = ["h1", "h2"]
#: Rows of documents that one batch enters at most, beyond the first four batches.
BATCH_ROWS = 50_000_000
#: Lines that hold more than one part in HOT of all lines are joined by broadcast; so at most HOT of them.
HOT = 256


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside take the order of a bucket's single file for granted, so merges need no sort."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """Levels of sorted runs; ``levels[i]`` holds fewer than ``fanout`` of them between batches."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Bucketed]] = []

    def runs(self) -> list[Bucketed]:
        return [run for level in self.levels for run in level]

    def entries(self) -> DataFrame:
        """All (h1, h2, owner), each hash once."""
        return _merged([run.df for run in self.runs()])

    def fresh(self, lines: DataFrame) -> DataFrame:
        """(h1, h2, owner) of the hashes of a batch that no run holds yet.

        The anti-join is spelled as an outer join, which stays above the grouping: a line that every
        document holds is combined before the shuffle.
        """
        fresh = lines.groupBy(*HASH).agg(F.min("doc_id").alias("owner"))
        for run in self.runs():
            known = run.df.select(*HASH, F.col("owner").alias("known"))
            fresh = fresh.join(known.hint("merge"), HASH, "left").filter("known is null").drop("known")
        return fresh

    def add(self, lines: DataFrame) -> None:
        """Enter the hashes of a batch (doc_id, h1, h2) that no run holds yet."""
        with _sorted_scans(self.spark):
            self._push(Bucketed(self.fresh(lines), "line_run_0", HASH, self.buckets), 0)

    def _push(self, run: Bucketed, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return
        old, self.levels[level] = self.levels[level], []
        merged = Bucketed(_merged([o.df for o in old]), f"line_run_{level + 1}", HASH, self.buckets)
        for run in old:
            run.drop()
        self._push(merged, level + 1)


def _merged(runs: list[DataFrame]) -> DataFrame:
    """The entries of runs that share no hash, as one sorted merge."""
    out = runs[0]
    for run in runs[1:]:
        out = out.withColumnRenamed("owner", "mine").join(run.hint("merge"), HASH, "full")
        out = out.select(*HASH, F.coalesce("mine", "owner").alias("owner"))
    return out


def hot_hashes(hashes: DataFrame) -> list[int]:
    """``h1`` of lines that may hold more than one part in HOT of all rows, by a mergeable sketch: at most HOT of them, all of a larger share among them."""
    row = hashes.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h1, {HOT}, {64 * HOT})").alias("top")).first()
    return [item["item"] for item in row["top"] or [] if item["count"] * HOT > row["n"]]


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for t, g in zip(text, gone):
        if t is None or g is None:
            out.append(None)
            continue
        drop = set(g)
        out.append("\n".join(line for i, line in enumerate(t.split("\n")) if i not in drop))
    return pd.Series(out, dtype=object)


def _body() -> Column:
    """Tells apart rows that repeat a doc_id with another text."""
    return F.xxhash64(text_of("text"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, body, pos, h1, h2) of each line whose key has ``min_chars`` code points; docs: doc_id, text. ``body`` is a hash of the text."""
    lines = docs.filter("doc_id is not null").select("doc_id", _body().alias("body"), F.posexplode(F.split(text_of("text"), "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    lines = lines.select("doc_id", "body", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
    return lines.select("doc_id", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def owned_before(hashes: DataFrame, index: LineRuns) -> DataFrame:
    """The lines of ``hashes`` whose owner is another, smaller doc_id; hot lines meet their owners by broadcast."""
    entries, hot = index.entries(), hot_hashes(hashes)
    if not hot:
        return hashes.join(entries.hint("merge"), HASH).filter("owner < doc_id")
    is_hot = F.col("h1").isin(hot)
    often = hashes.filter(is_hot).join(F.broadcast(entries.filter(is_hot)), HASH)
    return hashes.filter(~is_hot).join(entries.hint("merge"), HASH).unionByName(often).filter("owner < doc_id")


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept_text.

    A text splits at ``\\n``; null or empty is one empty line. A line's key is the line without
    blanks at its ends, A-Z lower-cased. Keys of ``min_chars`` code points or more that two
    documents hold lose all lines except in the smallest doc_id. Rows that repeat a doc_id are one
    document, whatever their texts, and each loses the lines that a smaller doc_id holds. Rows of a null doc_id own no line and lose none. An empty table gives an empty
    result; other columns are not read. ``batches`` is how many doc_id ranges are entered one
    after another (None: four, or one for each BATCH_ROWS rows): the result is the same for any number.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if batches is None:
        batches = max(4, math.ceil(docs.count() / BATCH_ROWS))
    cuts = [k / batches for k in range(1, batches)]
    bounds = docs.agg(F.percentile_approx("doc_id", cuts, 10000)).first()[0] if cuts else None
    batch = F.lit(0)
    for bound in sorted(set(bounds or [])):
        batch = batch + (F.col("doc_id") > bound).cast("int")
    hashes = Written(line_hashes(docs, min_chars).withColumn("batch", batch), "line-hashes", ["batch"])
    index = LineRuns(spark, fanout)
    for k in range(len(set(bounds or [])) + 1):
        index.add(hashes.df.filter(F.col("batch") == k))
    gone = (
        owned_before(hashes.df, index)
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("body").alias("gone_body"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    both = docs.join(gone, (F.col("doc_id") == F.col("gone_id")) & (_body() == F.col("gone_body")), "left")
    text = text_of("text")
    return both.select(
        "doc_id",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.coalesce(_without(F.when(F.col("gone").isNotNull(), text), F.col("gone")), text).alias("kept_text"),
    )


#: DuckDB, over the whole table.
ORACLE = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM e),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, coalesce(o.owner < k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
