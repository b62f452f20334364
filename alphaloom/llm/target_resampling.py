"""Draw documents whose hashed n-grams look like a target's, by importance weights and Gumbel noise.

1. Buckets of both tables are counted: each task sums one array of ``BUCKETS`` counts, and only those
   arrays are merged.
2. A document's weight is the sum of its buckets' gains, looked up in one array (80 kB, broadcast).
3. Eligible documents of a partition are sorted into a run, and each run is cut at keys of a sample into
   score ranges. Ranges are counted, so those beyond the draw are never merged, and each range knows the
   rank at which it begins.
4. A range's runs are merged by a tournament tree that reads them piece by piece: pieces arrive in the
   order of their first keys, and before one enters the tree all rows ahead of it leave. So a task holds
   at most one open piece of each run, whatever the range holds, and it stops at the exact count.

The CRC-32 of an n-gram is combined from those of its words (the checksum is linear), so bytes of a
word are read once for all n-grams.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, giving_back, text_of
from .token_counts import slices

BUCKETS = 10_000
SLICE = 1_000_000  # text bytes hashed together
REMEMBERED = 200_000  # distinct words whose checksums a worker keeps
PIECE = 256  # rows of a run that travel together
SAMPLE = 16_384  # expected rows of the sample that ranges are cut from
RANGE_ROWS = 65_536  # drawn rows for each range, about

#: Bytes of words, A-Z lower-cased; every other byte becomes a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.translate(_WORD_BYTES).split()


def _one_byte(v: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (v >> np.uint32(8)) ^ table[v & np.uint32(255)]


class Shift:
    """Checksums of a string followed by n zero bytes, before the following string's own is added."""

    SHORT = 64

    def __init__(self) -> None:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
        steps = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])]
        for _ in range(self.SHORT):
            steps.append(_one_byte(steps[-1], table))
        self.short = np.stack(steps).reshape(-1)
        self.powers = [steps[1]]
        for _ in range(31):  # a power applied to itself is the next
            self.powers.append(self._apply(self.powers[-1].reshape(-1), np.zeros(1024, np.int64), self.powers[-1].reshape(-1)).reshape(4, 256))

    @staticmethod
    def _apply(flat: np.ndarray, base: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = flat[base + (v & np.uint32(255))]
        for b in (1, 2, 3):
            out ^= flat[base + 256 * b + ((v >> np.uint32(8 * b)) & np.uint32(255))]
        return out

    def __call__(self, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = self._apply(self.short, np.minimum(n, self.SHORT) * 1024, v)
        long = np.flatnonzero(n > self.SHORT)
        if len(long):
            rest, w = n[long], v[long]
            for bit in range(32):
                on = np.flatnonzero(rest >> bit & 1)
                if len(on):
                    w[on] = self._apply(self.powers[bit].reshape(-1), np.zeros(len(on), np.int64), w[on])
            out[long] = w
        return out


class Hasher:
    """Checksums of all 1- to ``longest``-grams of documents, from remembered words."""

    def __init__(self, longest: int):
        self.longest, self.shift = longest, Shift()
        self.forget()

    def forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.sums: list[tuple[int, int, int]] = []

    def grams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; document and checksum of each n-gram."""
        if len(self.code) > REMEMBERED:
            self.forget()
        code, sums, rows = self.code, self.sums, []
        sizes = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = words_of(text)
            sizes[i] = len(words)
            for w in words:
                c = code.get(w)
                if c is None:
                    c = code[w] = len(sums)
                    sums.append((zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1))
                rows.append(c)
        at, doc = np.array(rows, np.int64), np.repeat(np.arange(len(texts)), sizes)
        known = np.array(sums, np.int64).reshape(-1, 3)
        gram, after, size = known[:, 0].astype(np.uint32)[at], known[:, 1].astype(np.uint32)[at], known[:, 2][at]
        docs, out = [doc], [gram]
        for n in range(1, self.longest):
            gram = self.shift(gram[:-1], size[n:]) ^ after[n:] if len(gram) > 1 else gram[:0]
            whole = doc[: len(gram)] == doc[n : n + len(gram)]
            docs.append(doc[: len(gram)][whole])
            out.append(gram[whole])
        return sizes, np.concatenate(docs), np.concatenate(out)


def bucket_counts(docs: DataFrame, longest: int = 3) -> np.ndarray:
    """How often each bucket's n-grams occur in the table's texts: ``BUCKETS`` whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(longest), np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                _, _, gram = hasher.grams(b.column("text").cast(pa.binary()).to_pylist())
                total += np.bincount(gram % np.uint32(BUCKETS), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    parts = docs.select(text_of("text").alias("text")).mapInArrow(giving_back(run), "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of each of B buckets."""
    all_s, all_t, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + b) / ((s + 1) * (all_t + b)))) for s, t in zip(map(int, source), map(int, target))], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, keyed by seed and id (a null id is empty text)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, longest: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(longest)
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                sizes, doc, gram = hasher.grams(b.column("text").cast(pa.binary()).to_pylist())
                features = np.bincount(doc, minlength=b.num_rows)
                weight = np.bincount(doc, gains[gram % np.uint32(BUCKETS)], minlength=b.num_rows).astype(np.int64)
                score = weight + np.array([noise(i, seed) for i in b.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, features, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return kept.mapInArrow(giving_back(run), "doc_id long, n_words long, n_features long, weight long, score long")


#: A row's place in the draw: best score, then smallest id (null last), then fewest features; ``row`` parts equal rows.
KEY = ["down", "no_id", "id", "n_features", "row"]


def _keyed(scored: DataFrame) -> DataFrame:
    return scored.select("*", (-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"))


_PIECE = "part long, run long, size long, " + ", ".join(f"first_{k} long" for k in KEY) + ", " + ", ".join(f"{k} array<long>" for k in [*KEY, "weight"])


def cut_runs(eligible: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Each partition sorted into a run, and runs cut at ``cuts`` (keys) into pieces of at most ``PIECE`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, cut = TaskContext.get().partitionId(), 0
        for b in batches:
            columns = [b.column(k).to_numpy() for k in [*KEY, "weight"]]
            keys = list(zip(*(c.tolist() for c in columns[: len(KEY)])))
            out: dict[str, list] = {k: [] for k in ["part", "run", "size", *(f"first_{k}" for k in KEY), *KEY, "weight"]}
            a = 0
            while a < len(keys):
                while cut < len(cuts) and keys[a] >= cuts[cut]:
                    cut += 1
                z = min(a + PIECE, len(keys))
                if cut < len(cuts) and keys[z - 1] >= cuts[cut]:
                    z = next(i for i in range(a, z) if keys[i] >= cuts[cut])
                for name, value in zip(out, [cut, me, z - a, *keys[a], *(c[a:z] for c in columns)]):
                    out[name].append(value)
                a = z
            yield pa.RecordBatch.from_pydict(out)

    return eligible.select(*KEY, "weight").sortWithinPartitions(*KEY).mapInArrow(run, _PIECE)


class Tournament:
    """A winner tree over open pieces: ``wins`` has at 1 the place of the least head, or an empty place."""

    def __init__(self) -> None:
        self.heads: list[tuple | None] = [None]
        self.rows: list[Iterator[tuple]] = [iter(())]
        self.free, self.wins = [0], [0, 0]

    def _better(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        return b if x is None or y is not None and y < x else a

    def _replay(self, place: int) -> None:
        node = (len(self.heads) + place) // 2
        size = len(self.heads)
        while node:
            left, right = 2 * node, 2 * node + 1
            self.wins[node] = self._better(left - size if left >= size else self.wins[left], right - size if right >= size else self.wins[right])
            node //= 2

    def add(self, rows: Iterator[tuple]) -> None:
        """A piece enters at an empty place; the tree doubles when there is none."""
        if not self.free:
            size = len(self.heads)
            self.heads += [None] * size
            self.rows += [iter(())] * size
            self.free = list(range(size, 2 * size))
            self.wins = [0] * (2 * size)
            for place in range(0, 2 * size, 2):
                self._replay(place)
        place = self.free.pop()
        self.rows[place] = rows
        self.heads[place] = next(rows, None)
        self._replay(place)

    def take(self, before: tuple | None) -> Iterator[tuple]:
        """Rows in order, as long as they are ahead of the key ``before`` (None: all)."""
        while True:
            place = self.wins[1] if len(self.heads) > 1 else 0
            head = self.heads[place]
            if head is None or before is not None and head >= before:
                return
            yield head
            self.heads[place] = next(self.rows[place], None)
            if self.heads[place] is None:
                self.rows[place] = iter(())
                self.free.append(place)
            self._replay(place)


def merge_ranges(pieces: DataFrame, begins: dict[int, int], draw: int, tasks: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, key columns) of the ranges in ``begins``, which has the rows ahead of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, given, out = None, Tournament(), 0, []

        def drain(before: tuple | None) -> None:
            nonlocal given
            if now is not None and given < draw:
                for head in tree.take(before):
                    given += 1
                    out.append((*head, given))
                    if given == draw:
                        return

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * (len(KEY) + 2)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*KEY, "weight", "rank"])

        for b in batches:
            parts, firsts = b.column("part").to_pylist(), list(zip(*(b.column(f"first_{k}").to_pylist() for k in KEY)))
            for i, part in enumerate(parts):
                if part != now:
                    drain(None)
                    now, tree, given = part, Tournament(), begins[part]
                if given >= draw:
                    continue
                drain(firsts[i])
                tree.add(iter(list(zip(*(b.column(k)[i].values.to_pylist() for k in [*KEY, "weight"])))))
                if len(out) >= 8192:
                    yield packed()
                    out.clear()
        drain(None)
        yield packed()

    dealt = pieces.repartition(tasks, "part").sortWithinPartitions("part", *(f"first_{k}" for k in KEY))
    merged = dealt.mapInArrow(run, ", ".join(f"{k} long" for k in [*KEY, "weight", "rank"]))
    return merged.select(F.when(F.col("no_id") == 0, F.col("id")).alias("doc_id"), "n_features", "weight", (-F.col("down")).alias("score"), "rank", *(k for k in KEY if k != "n_features"))


def _key_of(columns: list[str | Column]) -> Column:
    return F.struct(*columns)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, longest: int = 3, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank (null: not drawn).

    ``target`` has a column text. Of the N rows with at least ``least_words`` words, floor(``percent`` * N / 100)
    with the highest scores are drawn, ties to the smaller doc_id (null last), then to fewer features;
    rows equal in all of that share their ranks in any order. Null and empty texts have no words,
    weight 0 and the noise alone as score. Rows that repeat a doc_id are drawn one by one. An empty
    target weighs rare buckets up; an empty ``docs`` gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, longest), bucket_counts(target, longest))
    scored = Written(score_documents(docs, gains, longest, seed).withColumn("row", F.monotonically_increasing_id()), "resample-scored").df
    eligible = _keyed(scored.filter(F.col("n_words") >= least_words))
    n = eligible.count()
    draw = percent * n // 100
    if not draw:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    chosen = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))
    sample = sorted(tuple(r) for r in eligible.filter(chosen).select(*KEY).collect())  # about SAMPLE rows of five numbers, whatever n
    top = sample[: math.ceil(draw / n * len(sample) + 4 * math.sqrt(draw / n * len(sample)))]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), draw // RANGE_ROWS)
    cuts = sorted({top[k * len(top) // ranges] for k in range(1, ranges)} | set(top[-1:])) if top else []
    pieces = Written(cut_runs(eligible, cuts), "resample-runs").df
    begins, ahead = {}, 0
    for r in pieces.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect():  # at most SAMPLE ranges
        if ahead < draw:
            begins[r.part] = ahead
        ahead += r.n
    drawn = Written(merge_ranges(pieces.filter(F.col("part") <= max(begins)), begins, draw, ranges), "resample-drawn").df
    last = drawn.filter(F.col("rank") == draw).select(*KEY).first()
    beyond = _key_of(KEY) > F.struct(*(F.lit(v).cast("long") for v in last))
    rest = _keyed(scored).filter((F.col("n_words") < least_words) | beyond)
    columns = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*columns, "rank").unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
