"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, media, packing, periodic_runs, pii, quality_fm, repeats, sentencepiece_dropout, simhash, target_resampling, token_counts, toxicity
from .features import fold


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_dropout.encode_pieces(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = media.written_blocks(media.read_back(media.store(documents(spark, sf_dir))))
    return media.assemble(blocks).select(
        "doc_id",
        "n_bytes",
        F.length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pcm, -64, 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), keep_ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_fm.score_quality(docs, quality_fm.train(docs, labels(spark, sf_dir)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = toxicity.score_toxicity(docs, toxicity.train(docs, labels(spark, sf_dir)))
    held_out = fold(F.col("row.doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT
    return out.select("row.doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", repeats.removed_bytes().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def cycle_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by checksum of its id (null: empty text) repeats a stretch of its words to its end."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(documents(spark, sf_dir), edit=cycle_words)
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = out.withColumn("best", longest)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        "best.length",
        (-F.col("best.period")).alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_media": op4_media,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_target_resampling": op13_target_resampling,
}
ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE}
