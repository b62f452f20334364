"""Bounded-space online packing of documents into token windows.

Every task reads its documents once and keeps at most ``open_windows`` windows: a document's last
part goes to the fullest window that still takes it; where none does, the fullest is emitted. A gap
of ``min_cut`` tokens or more is first filled by cutting the document; smaller gaps become padding.
Windows still open at a task's end are few (``open_windows`` a task at most); those of ``merge``
neighbouring tasks are packed again together, and the last tokens of such a group are cut into
sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, giving_back
from .token_counts import slices, tokenizer_path, worker_tokenizer

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
COLUMNS = [x.split()[0] for x in PIECE.split(", ")]
#: Characters from which a text's ids come from overlapping chunks.
HUGE = 65_536
#: Sequences of merged leftovers are numbered from here.
MERGED = 1 << 52
Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, doc_tokens


class Windows:
    """The open windows of one task; closed ones appear in ``closed`` as lists of pieces."""

    def __init__(self, size: int, most: int, min_cut: int):
        self.size, self.most, self.min_cut = size, most, min_cut
        self.rooms: list[tuple[int, int]] = []  # (room, number), sorted
        self.open: dict[int, list[Piece]] = {}
        self.opened = 0
        self.closed: list[list[Piece]] = []

    def add(self, doc_id: int | None, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        while len(ids) >= self.size:
            self.closed.append([(doc_id, start, ids[: self.size], total)])
            ids, start = ids[self.size :], start + self.size
        while len(ids):
            i = bisect.bisect_left(self.rooms, (len(ids), -1))
            if i < len(self.rooms):  # the fullest window that takes it
                self._put(i, (doc_id, start, ids, total))
                return
            if len(self.open) < self.most:
                self.open[self.opened] = []
                bisect.insort(self.rooms, (self.size, self.opened))
                self.opened += 1
                continue
            room, number = self.rooms[0]  # none takes it: the fullest is emitted
            if room >= self.min_cut:
                self._put(0, (doc_id, start, ids[:room], total))
                ids, start = ids[room:], start + room
            else:
                self.rooms.pop(0)
                self.closed.append(self.open.pop(number))

    def _put(self, i: int, piece: Piece) -> None:
        room, number = self.rooms.pop(i)
        self.open[number].append(piece)
        if room == len(piece[2]):
            self.closed.append(self.open.pop(number))
        else:
            bisect.insort(self.rooms, (room - len(piece[2]), number))


def _rows(sequences: list[list[Piece]], first: int) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in COLUMNS}
    for n, pieces in enumerate(sequences):
        at = 0
        for doc_id, start, ids, total in pieces:
            for c, v in zip(COLUMNS, (doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, first + n, at)):
                out[c].append(v)
            at += len(ids)
    return out


def merge_leftovers(pieces: list[Piece], size: int, min_cut: int) -> list[list[Piece]]:
    """Sequences of all the pieces: best fit from the longest, then what is far from full end to end."""
    windows = Windows(size, len(pieces) + 1, min_cut)
    for doc_id, start, ids, total in sorted(pieces, key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1])):
        windows.add(doc_id, ids, start, total)
    out, rest = windows.closed, []
    for room, number in windows.rooms:
        (out.append if room < min_cut else rest.extend)(windows.open[number])
    left = sum(len(p[2]) for p in rest)
    while left:
        goal = size if left >= size else 1 << (left.bit_length() - 1)
        left -= goal
        sequence = []
        while goal:
            doc_id, start, ids, total = rest.pop(0)
            sequence.append((doc_id, start, ids[:goal], total))
            if len(ids) > goal:
                rest.insert(0, (doc_id, start + goal, ids[goal:], total))
            goal -= len(sequence[-1][2])
        out.append(sequence)
    return out


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 1, open_windows: int = 64, min_cut: int = 16, merge: int = 4, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32 bit), ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids, then ``end_id``; each id lies in exactly one piece, and the pieces
    of a sequence lie at offsets without gaps from 0. Null and empty texts are one piece of
    ``end_id`` alone. Rows are packed one by one, so repeated rows and null ids each have pieces of
    their own; an empty table gives an empty result, and other columns are not read. With
    ``keep_ids`` false, ids is null in the result (the checksum is not), which spares disk.
    """
    if size & (size - 1) or not 0 < min_cut <= size:
        raise ValueError("size must be a power of two, and min_cut within it")
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task = worker_tokenizer(path, chunk=HUGE), TaskContext.get().partitionId()
        windows, first = Windows(size, open_windows, min_cut), task << 24

        def out(sequences: list[list[Piece]], leftover: bool) -> pa.RecordBatch:
            rows = _rows(sequences, first) | {"part": [task if leftover else None] * sum(map(len, sequences))}
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        for whole in batches:
            for b in slices(whole, "text", 2_000_000):
                ids, offsets = tok.encode(b.column("text"))
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                for doc_id, a, z in zip(b.column("doc_id").to_pylist(), offsets, offsets[1:]):
                    windows.add(doc_id, ids[a:z])
                yield out(windows.closed, False)
                first += len(windows.closed)
                windows.closed = []
                for number, pieces in windows.open.items():  # let go of the batch's array
                    windows.open[number] = [(d, s, x.copy() if x.base is not None else x, t) for d, s, x, t in pieces]
        yield out(list(windows.open.values()), True)

    schema = pa.schema([(c, pa.binary() if t == "binary" else pa.int64()) for c, t in (x.split() for x in PIECE.split(", "))] + [("part", pa.int64())])
    raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(run), f"{PIECE}, part long")
    raw = raw.withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        raw = raw.withColumn("ids", F.when(F.col("part").isNotNull(), F.col("ids")))
    placed = Written(raw, "packed").df

    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pieces = [(None if pd.isna(d) else int(d), int(s), np.frombuffer(i, "<u4"), int(t)) for d, s, i, t in zip(rows["doc_id"], rows["start"], rows["ids"], rows["doc_tokens"])]
        out = pd.DataFrame(_rows(merge_leftovers(pieces, size, min_cut), MERGED + (int(key[0]) << 28)))
        return out.astype({"doc_id": "Int64"})

    left = placed.filter("part is not null").withColumn("g", F.floor(F.col("part") / merge))
    merged = left.groupBy("g").applyInPandas(again, PIECE).withColumn("ids_crc32", F.crc32("ids"))
    columns = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    result = placed.filter("part is null").select(columns).unionByName(merged.select(columns))
    return result if keep_ids else result.drop("ids")
