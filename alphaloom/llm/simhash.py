"""SimHash near-dedup: fingerprints of word shingles, linked through a Gray-order index.

Fingerprints are computed once, in Arrow batches, and written to the shared folder. Distinct
fingerprints are routed to buckets on which any two within ``k`` bits agree at least once; a task
indexes its buckets (``hamming_index``) and returns at most one edge per fingerprint and bucket, never
all pairs. A bucket of more than ``bucket_rows`` fingerprints is cut into chunks, and each pair of
chunks is a bucket of its own, so hot patterns spread over tasks and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, giving_back, kept_rows, text_of
from .components import component_roots
from .hamming_index import routing_masks, spanning_links

#: Shingles whose bits are counted at a time.
COUNTED = 100_000


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> bytes:
    """The big-endian fingerprint of a UTF-8 text."""
    from xxhash import xxh64_digest

    parts = text.lower().split()  # of bytes: A-Z and the six ASCII blanks
    if not parts:
        return bytes(8)
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_digest(line, seed)
    ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    n = len(parts) - words + 1
    ones = np.zeros(64, np.int64)
    for i in range(0, n, COUNTED):
        j = min(n, i + COUNTED)
        hashes = b"".join([xxh64_digest(line[a:z], seed) for a, z in zip(starts[i:j], ends[i + words - 1 : j + words - 1])])
        ones += np.add.reduce(np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def _body() -> Column:
    """Tells apart rows that repeat a doc_id with another text."""
    return F.xxhash64(text_of("text"))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, body (a hash of the text), fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").fill_null("").cast(pa.binary())
            bits = b"".join(fingerprint(t.as_py(), words) for t in texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("body"), pa.array(np.frombuffer(bits, ">i8").astype(np.int64))], ["doc_id", "body", "fp"])

    docs = docs.select(F.col("doc_id").cast("long"), _body().alias("body"), F.col("text").cast("string"))
    return docs.mapInArrow(giving_back(run), "doc_id long, body long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, k: int, bucket_rows: int = 2048) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of ``nodes`` (fp) that connect all within k bits."""
    masks = routing_masks(nodes.count(), k)
    routes = F.array(*(F.struct(F.lit(i).alias("route"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    routed = nodes.select("fp", F.explode(routes).alias("r")).select("fp", "r.*")
    hot = Written(routed.groupBy("route", "key").count().filter(F.col("count") > bucket_rows), "simhash-hot").df
    if hot.isEmpty():
        routed = routed.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    else:
        chunks = hot.select("route", "key", F.ceil(F.col("count") / bucket_rows).alias("chunks"))
        routed = routed.join(chunks, ["route", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        routed = routed.withColumn("own", F.pmod(F.xxhash64("fp"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        routed = routed.select("fp", "route", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    place = ["route", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 100_000:  # all but the last bucket are complete
                table = pa.Table.from_batches(held)
                _, starts = _buckets(table)
                if starts[-1]:
                    yield linked(table.slice(0, starts[-1]))
                held = table.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            yield linked(pa.Table.from_batches(held))

    def _buckets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        columns = [table.column(c).to_numpy() for c in place]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new), np.flatnonzero(new)

    def linked(table: pa.Table) -> pa.RecordBatch:
        child, root = spanning_links(_buckets(table)[0], table.column("fp").to_numpy().view(np.uint64), k)
        return pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(root.view(np.int64))], ["a", "b"])

    return routed.repartition(*place).sortWithinPartitions(*place).mapInArrow(giving_back(run), "a long, b long")


def _grouped(docs: DataFrame, words: int, k: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, body, fp, and the first row (id, body) of its component."""
    fps = Written(fingerprints(docs, words), "simhash").df
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("body").alias("body")))
    nodes = Written(fps.groupBy("fp").agg(first.alias("first")), "simhash-nodes").df
    stars = component_roots(links(nodes.select("fp"), k), "simhash-edges")
    rooted = nodes.join(stars, nodes["fp"] == stars["u"], "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    component = rooted.join(least, "root").select("fp", F.col("least.id").alias("least_id"), F.col("least.body").alias("least_body"))
    return fps.join(component, "fp")


def near_duplicates(docs: DataFrame, words: int = 4, k: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, fp, component_id (the smallest doc_id reachable over links of at most k bits).

    Words are the runs without ASCII blanks of the text with A-Z lower-cased; a bit of the
    fingerprint is 1 if over half the shingles' XXH64 values have it, repeats included. Fewer words
    than a shingle: the whole sequence is hashed; none (empty, null): zero, linked like any other.
    Repeated rows each get their row. A null doc_id takes part in links but is no component's
    smallest, except where all ids are null (component_id null). Empty tables give empty results;
    other columns are not read.
    """
    return _grouped(docs, words, k).select("doc_id", "fp", F.col("least_id").alias("component_id"))


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, words: int = 4, k: int = 4) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest doc_id (null last; of several texts under it one)."""
    best = F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("body") == F.col("least_body"))
    verdicts = _grouped(docs, words, k).select("doc_id", F.col("body").alias("digest"), best.alias("kept"))
    return kept_rows(docs, _body(), verdicts, "simhash-odd")
