"""Media columns: texts stored losslessly as FLAC, read back as PCM blocks with seekable offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, giving_back
from .flac import decode_streams, encode_streams
from .token_counts import slices

UNIT = 64


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def store(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, media (the FLAC stream of its payload).

    Null and empty texts have a payload of 64 zeros. Equal texts have equal streams, whatever else is
    in the table; repeated rows and null ids are rows like any other, and empty tables give empty results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 4_000_000):
                texts = b.column("text").fill_null("").cast(pa.binary()).to_pylist()
                media = encode_streams([payload_of(t) for t in texts])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature_of(pcm: bytes, blocks: int) -> str:
    """Peak, energy, mean and sign changes of the samples, in whole numbers."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"blocks={blocks};peak={int(np.abs(x).max())};energy={int((x * x).sum())};sum={int(x.sum())};turns={turns}"


_SEEK = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("n_samples", pa.int64())]))


def read_back(stored: DataFrame) -> DataFrame:
    """``stored`` (doc_id, n_bytes, media) with pcm, seek (an array of sample_offset, byte_offset, n_samples for each frame) and feature.

    Every frame's CRC-16 and every stream's MD5 are verified; a wrong one fails the task. Null media
    give null pcm, seek and feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media", 4_000_000):
                media = b.column("media").to_pylist()
                read = iter(decode_streams([m for m in media if m is not None]))
                rows = [None if m is None else next(read) for m in media]
                seek = [None if d is None else [dict(zip(("sample_offset", "byte_offset", "n_samples"), s)) for s in d.seek] for d in rows]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("n_bytes"), b.column("media"), pa.array([d and d.pcm for d in rows], pa.binary()), pa.array(seek, _SEEK), pa.array([d and feature_of(d.pcm, len(d.seek)) for d in rows], pa.string())],
                    ["doc_id", "n_bytes", "media", "pcm", "seek", "feature"],
                )

    return stored.mapInArrow(run, "doc_id long, n_bytes long, media binary, pcm binary, seek array<struct<sample_offset: long, byte_offset: long, n_samples: long>>, feature string")


def pcm_blocks(read: DataFrame) -> DataFrame:
    """One row per block of ``read_back``: doc_id, sample_offset, byte_offset (of its frame in the stream), n_samples, pcm."""
    s = read.select("doc_id", "pcm", F.explode("seek").alias("s"))
    return s.select("doc_id", "s.*", F.expr("substring(pcm, int(s.sample_offset) + 1, int(s.n_samples))").alias("pcm"))


def written_blocks(read: DataFrame, label: str = "pcm-blocks") -> DataFrame:
    """``read_back`` written to the shared folder as PCM blocks, and read again: doc_id, n_bytes, media_bytes, media_sha256, blocks.

    A row's blocks are an array of sample_offset, byte_offset (of the frame in the stream), n_samples and pcm. The
    stream itself is not written again: its size and digest stand for it.
    """
    block = "transform(seek, s -> struct(s.sample_offset AS sample_offset, s.byte_offset AS byte_offset, s.n_samples AS n_samples, substring(pcm, int(s.sample_offset) + 1, int(s.n_samples)) AS pcm))"
    return Written(read.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.expr(block).alias("blocks")), label).df


def assemble(written: DataFrame) -> DataFrame:
    """``written_blocks`` with pcm (the blocks joined) and feature instead of blocks.

    Blocks that do not follow one another from sample 0 on fail the task. Null blocks give null pcm and feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("blocks")
            flat, cuts, given = lists.flatten(), lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            cuts = cuts - cuts[0]
            offset, pcm = flat.field("sample_offset").to_numpy(), flat.field("pcm")
            size = pc.binary_length(pcm).to_numpy(zero_copy_only=False)
            out, feature = [], []
            for a, z, ok in zip(cuts.tolist(), cuts[1:].tolist(), given.tolist()):
                if ok and (np.append(0, np.cumsum(size[a:z]))[:-1] != offset[a:z]).any():
                    raise ValueError("blocks do not follow one another")
                out.append(b"".join(pcm[a:z].to_pylist()) if ok else None)
                feature.append(feature_of(out[-1], z - a) if ok else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256")), pa.array(out, pa.binary()), pa.array(feature, pa.string())], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "pcm", "feature"])

    return written.mapInArrow(giving_back(run), "doc_id long, n_bytes long, media_bytes long, media_sha256 string, pcm binary, feature string")


def write_pcm(stored: DataFrame, path: str, blocks_per_part: int = 1024) -> None:
    """Decodes ``stored`` and writes its blocks to ``path`` as Parquet, partitioned by ``part`` (sample_offset // (1,024 * ``blocks_per_part``)).

    A span of samples is then read from the parts and row groups that hold it (``seek_samples``), not from
    the streams. Null media give no blocks; an empty table gives an empty one.
    """
    blocks = pcm_blocks(read_back(stored)).withColumn("part", F.floor(F.col("sample_offset") / (1024 * blocks_per_part)))
    blocks.sortWithinPartitions("part", "doc_id", "sample_offset").write.partitionBy("part").mode("overwrite").parquet(path)


def seek_samples(spark: SparkSession, path: str, first: int, last: int, blocks_per_part: int = 1024) -> DataFrame:
    """(doc_id, sample_offset, pcm) of the samples ``first`` to ``last`` (exclusive) of every stream written by ``write_pcm``, by block."""
    size = 1024 * blocks_per_part
    blocks = spark.read.parquet(path).filter(F.col("part").between(first // size, max(first, last - 1) // size))
    blocks = blocks.filter((F.col("sample_offset") < last) & (F.col("sample_offset") + F.col("n_samples") > first))
    skip = F.greatest(F.lit(first) - F.col("sample_offset"), F.lit(0))
    n = F.least(F.lit(last) - F.col("sample_offset"), F.col("n_samples")) - skip
    return blocks.select("doc_id", (F.col("sample_offset") + skip).alias("sample_offset"), F.col("pcm").substr((skip + 1).cast("int"), n.cast("int")).alias("pcm"))
