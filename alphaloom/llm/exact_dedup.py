"""Exact dedup by skew-safe combining, in DataFrame operations only.

A document's content is its text without blanks. Copies are combined in three stages, and every
stage groups by digest *and* full content, so two texts that merely share a digest never meet:

1. locally: the partial aggregate before the first exchange leaves one row per content and task;
2. salted: each content's local winners meet in at most ``salts`` tasks, so that a content that
   holds a third of all rows is spread before anything is gathered;
3. globally: at most ``salts`` winners of a content meet.

The winners without their content (a few dozen bytes) are written to the shared folder and joined
back to the documents by digest. Spark splits the skewed partitions of that join (AQE). Should two
contents ever share a digest, those few digests are joined by content instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Written, kept_rows, text_of


def content_of(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, size, sha, body (a hash of the text) and whether it is the very row that stays."""
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("n"), F.xxhash64(text).alias("body"), content_of(text).alias("content"))
    base = base.withColumn("sha", F.sha2("content", 256))
    # primitive buffers only, so that every stage aggregates by hash: the smallest id of each content and length
    least = [F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("body", "doc_id"), F.min("body")).alias("body")]
    salted = (
        base.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("sha", "content", "n", "salt")
        .agg(*least, F.count(F.lit(1)).alias("size"))
        .repartition("sha")  # both groupings below are dealt by it
    )
    merged = salted.groupBy("sha", "content", "n").agg(*least, F.sum("size").alias("size")).groupBy("sha", "content")
    merged = merged.agg(F.max_by("doc_id", "n").alias("keep_id"), F.max_by("body", "n").alias("keep_body"), F.max("n").alias("keep_n"), F.sum("size").alias("size"))
    found = ["keep_id", "keep_body", "keep_n", "size"]
    winners = Written(merged.select("sha", *found), "exact-winners").df
    shared = winners.groupBy("sha").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    narrow = base.select("doc_id", "n", "body", "sha")
    if shared.isEmpty():
        joined = narrow.join(winners, "sha")
    else:  # two contents under one digest: those digests are matched by content
        clash = shared.select("sha")
        full = merged.join(clash, "sha", "left_semi").select("sha", "content", *found)
        plain = narrow.join(winners.join(clash, "sha", "left_anti"), "sha")
        exact = base.join(clash, "sha", "left_semi").join(full, ["sha", "content"]).select("sha", "doc_id", "n", "body", *found)
        joined = plain.unionByName(exact)
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")) & (F.col("body") == F.col("keep_body"))
    return joined.select("doc_id", "keep_id", "size", "sha", "body", best.alias("best"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row that stays has the most code points in its original text, then the smallest id.
    Null text counts as empty; all empty texts are one group. A null id loses every tie, and a
    group of nothing but null ids has keep_id null and is kept. Rows that repeat an id with an
    equal text are one document listed twice: both count in group_size and share ``kept``; with
    another text they are judged row by row. An empty table gives an empty result. Other columns,
    whatever their names, are not read.
    """
    return _verdicts(docs, id_col, text_col, salts).select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_exact(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row of ``docs`` for each content, with all its columns: most code points, then smallest doc_id (null last)."""
    verdicts = _verdicts(docs, "doc_id", "text", salts).select("doc_id", F.col("body").alias("digest"), F.col("best").alias("kept"))
    return kept_rows(docs, F.xxhash64(text_of("text")), verdicts, "exact-odd")


#: DuckDB, over the whole table.
ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k
  FROM documents),
w AS (
  SELECT doc_id, k,
         first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY k) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM w
"""
