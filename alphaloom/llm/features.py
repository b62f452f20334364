"""Hashed word and structure features of Arrow text batches, and bounded labelled samples."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AROUND = ".,;:!?()[]{}\"'*&#$%|<>=+-_/\\~^`"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every word, and the distinct bare words (lower case, punctuation stripped)."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    bare = pc.utf8_trim(pc.utf8_lower(flat.dictionary), _AROUND).dictionary_encode()
    code = bare.indices.to_numpy()[flat.indices.to_numpy()] if len(row) else np.empty(0, np.int32)
    return row, code, bare.dictionary


def buckets_of(names: pa.Array, dim: int, key: int = 0) -> np.ndarray:
    """Hash bucket of each distinct word, under a key."""
    return np.fromiter((zlib.crc32(w, key) % dim for w in names.cast(pa.binary()).to_pylist()), np.int64, len(names))


#: Byte classes counted by ``structure``.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?", b"!*&$%#", b"|", b"\n", b" \t\r\x0b\x0c")
STRUCTURE = len(_CLASSES) + 5


def structure(texts: pa.Array, row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(rows, STRUCTURE): shares of byte classes, repetition and size, each within about 0 to 1."""
    n = len(texts)
    texts = texts.fill_null("")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    table = np.full(256, len(_CLASSES), np.uint8)
    for i, chars in enumerate(_CLASSES):
        table[list(chars)] = i
    key = np.repeat(np.arange(n) * (len(_CLASSES) + 1), sizes) + table[raw]
    counts = np.bincount(key, minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)[:, : len(_CLASSES)]
    words = np.bincount(row, minlength=n)
    pair, times = np.unique(row * (int(code.max()) + 1 if len(code) else 1) + code, return_counts=True)
    owner = pair // (int(code.max()) + 1 if len(code) else 1)
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    again = np.bincount(row[1:][(row[1:] == row[:-1]) & (code[1:] == code[:-1])], minlength=n) if len(row) else np.zeros(n)
    per_word = np.maximum(words, 1)
    return np.column_stack([counts / np.maximum(sizes, 1)[:, None], distinct / per_word, top / per_word, again / per_word, np.log1p(words) / 10, np.minimum(sizes / per_word, 20) / 20])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: fold of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, extra: list[Column] | None = None) -> DataFrame:
    """(doc_id, text, y, extra columns) of at most ``most`` labelled documents outside the held-out fold, chosen by hash of the id.

    One row for each id: of rows that repeat one, the greatest.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).alias("y")).filter("doc_id is not null and y is not null")
    known = known.filter(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    row = F.struct(F.col("text").cast("string").alias("text"), *(extra or []))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row")).join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of two numbers
    return found.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("row").alias("row")).select("doc_id", "y", "row.*")
