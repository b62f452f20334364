"""A table of facts in immutable versions: atomic commits, pinned reads, increments that are safe to repeat, content digests.

A version is one JSON file that names the folders holding its rows, one entry for each month and
folder. Data folders are never changed once written; a commit writes new ones beside the old and then moves
the next version's file to its final name, which fails if another writer was first. So a reader sees a
whole version or the one before it, and a crash leaves folders that no version names.

Every entry carries a digest of its rows that does not depend on their order. Digests of months add up
from those of their entries, and a small hash tree (months, years, all) finds what differs between two
versions, or two copies of a table, without reading a row of either.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "all"


class Conflict(RuntimeError):
    """Another writer committed first."""


def row_hash(columns: list[str]) -> Column:
    """60 bits of the MD5 of a row's named columns as text (null: one zero byte; columns parted by byte 1)."""
    text = F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def digests(df: DataFrame, columns: list[str], by: str | Column) -> DataFrame:
    """part, n, low, high, mix: count, the sums of both halves of the row hashes, and their xor, for each value of ``by``.

    Equal for any order and partitioning of the rows; digests of parts of a table add up (mix: by xor). A
    repeated row counts each time.
    """
    h = row_hash(columns)
    sums = df.select((F.col(by) if isinstance(by, str) else by).alias("part"), h.alias("_h")).groupBy("part")
    return sums.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_h") % (1 << 30)).alias("low"), F.sum(F.shiftright("_h", 30)).alias("high"), F.bit_xor("_h").alias("mix"))


@dataclass(frozen=True)
class Digest:
    n: int = 0
    low: int = 0
    high: int = 0
    mix: int = 0

    def __add__(self, other: Digest) -> Digest:
        return Digest(self.n + other.n, self.low + other.low, self.high + other.high, self.mix ^ other.mix)

    @property
    def text(self) -> str:
        return f"{self.n}:{self.low}:{self.high}:{self.mix}"


@dataclass(frozen=True)
class Entry:
    """Rows of one month in one folder."""

    month: str
    folder: str
    digest: Digest


@dataclass(frozen=True)
class Version:
    number: int = 0
    entries: tuple[Entry, ...] = ()
    batches: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    schema: str = ""
    note: str = field(default="", compare=False)

    def months(self) -> dict[str, Digest]:
        out: dict[str, Digest] = {}
        for e in self.entries:
            out[e.month] = out.get(e.month, Digest()) + e.digest
        return out

    def tree(self) -> dict[str, dict[str, str]]:
        """Hash tree: node -> its children's hashes. The children of ``ROOT`` are years, those of a year months."""
        years: dict[str, dict[str, str]] = {}
        for month, digest in sorted(self.months().items()):
            if digest.n:
                years.setdefault(month[:4], {})[month] = hashlib.sha256(digest.text.encode()).hexdigest()
        whole = {year: hashlib.sha256("\n".join(f"{k} {v}" for k, v in sorted(kids.items())).encode()).hexdigest() for year, kids in years.items()}
        return {ROOT: whole, **years}

    def root(self) -> str:
        return hashlib.sha256("\n".join(f"{k} {v}" for k, v in sorted(self.tree()[ROOT].items())).encode()).hexdigest()


def changed_months(a: Version, b: Version) -> list[str]:
    """Months whose rows differ: subtrees of equal hash are not entered."""
    if a.root() == b.root():
        return []
    ta, tb = a.tree(), b.tree()
    out = []
    for year in sorted(ta[ROOT].keys() | tb[ROOT].keys()):
        if ta[ROOT].get(year) != tb[ROOT].get(year):
            x, y = ta.get(year, {}), tb.get(year, {})
            out += [m for m in sorted(x.keys() | y.keys()) if x.get(m) != y.get(m)]
    return out


class VersionedStore:
    """Rows of (code, dt, ...) below ``path``. ``columns`` are those that digests cover (default: all of the first commit).

    ``step`` is called with the name of each step of a commit (tests stop there).
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str] | None = None, step: Callable[[str], None] = lambda name: None):
        self.spark, self.path, self.columns, self.step = spark, path.rstrip("/"), columns, step

    # --- files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._files(), self._path("versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The named version, or the newest; an empty one before the first commit."""
        numbers = self.versions()
        if number is None:
            number = numbers[-1] if numbers else 0
        if number == 0:
            return Version()
        if number not in numbers:
            raise KeyError(f"no version {number}")
        stream = self._files().open(self._path(f"versions/{number:08d}.json"))
        try:
            held = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        entries = tuple(Entry(e["month"], e["folder"], Digest(*e["digest"])) for e in held["entries"])
        return Version(held["version"], entries, tuple(held["batches"]), tuple(held["columns"]), held["schema"], held["note"])

    def _commit(self, v: Version) -> Version:
        """Moves the version's file to its name; ``Conflict`` if that name is taken."""
        fs, name = self._files(), f"versions/{v.number:08d}.json"
        body = {"version": v.number, "note": v.note, "columns": v.columns, "schema": v.schema, "batches": v.batches, "entries": [{"month": e.month, "folder": e.folder, "digest": [e.digest.n, e.digest.low, e.digest.high, e.digest.mix]} for e in v.entries]}
        beside = self._path(f"versions/.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        try:
            stream.write(json.dumps(body).encode())
        finally:
            stream.close()
        self.step("manifest written")
        jvm = self.spark._jvm.org.apache.hadoop.fs
        whole = jvm.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark._sc._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
        try:
            whole.rename(beside, self._path(name), no_overwrite)
        except Exception as e:
            fs.delete(beside, False)
            if fs.exists(self._path(name)):
                raise Conflict(name) from e
            raise
        self.step("committed")
        return v

    # --- writing

    def _entries(self, df: DataFrame, columns: tuple[str, ...], dealt: bool = False) -> tuple[Entry, ...]:
        """Writes rows to a new folder and names its months. A large month becomes several files, by ranges of codes, unless rows are ``dealt``."""
        folder = f"data/{uuid.uuid4().hex}"
        self.step("before data")
        df = df.withColumn("month", F.date_format(F.trunc("dt", "month"), "yyyy-MM-dd"))
        (df if dealt else df.repartitionByRange("month", "code")).sortWithinPartitions("month", "code", "dt").write.partitionBy("month").parquet(f"{self.path}/{folder}")
        self.step("data written")
        held = self._read_folders([folder], df.drop("month").schema.simpleString()[7:-1])
        rows = digests(held, list(columns), F.date_format(F.trunc("dt", "month"), "yyyy-MM-dd")).collect()  # a row a month
        return tuple(Entry(r.part, f"{folder}/month={r.part}", Digest(r.n, r.low, r.high, r.mix)) for r in sorted(rows, key=lambda r: r.part))

    def _read_folders(self, folders: list[str], schema: str) -> DataFrame:
        reader = self.spark.read.schema(", ".join(x.replace(":", " ", 1) for x in _fields(schema))).option("recursiveFileLookup", "true")
        return reader.parquet(*(f"{self.path}/{f}" for f in folders))

    def _checked(self, df: DataFrame, v: Version) -> tuple[tuple[str, ...], str]:
        schema = df.schema.simpleString()[7:-1]
        if v.schema and sorted(_fields(schema)) != sorted(_fields(v.schema)):
            raise ValueError(f"columns differ from the store's: {schema} / {v.schema}")
        return v.columns or tuple(self.columns or sorted(df.columns)), v.schema or schema

    def append(self, df: DataFrame, batch: str, retries: int = 5, dealt: bool = False) -> Version:
        """Adds the rows of a batch once: a batch that the store knows is not written again, so a repeat after a crash is safe.

        Rows need a date in ``dt``. Under concurrent writers the data is written once and the commit is
        tried on top of whatever came first. ``dealt``: each date's rows lie in one partition already, and are written from
        there without a shuffle (whose sampling would compute them twice).
        """
        entries = None
        for _ in range(retries + 1):
            v = self.version()
            if batch in v.batches:
                return v
            columns, schema = self._checked(df, v)
            if entries is None:
                entries = self._entries(df.select(*(x.split(":")[0] for x in _fields(schema))), columns, dealt)
            try:
                return self._commit(replace(v, number=v.number + 1, entries=v.entries + entries, batches=(*v.batches, batch), columns=columns, schema=schema, note=f"append {batch}"))
            except Conflict:
                continue
        raise Conflict(f"append {batch}")

    def rewrite(self, change: Callable[[DataFrame], DataFrame], touched: Column, note: str) -> Version:
        """Replaces the months that hold a row with ``touched`` by ``change`` of their rows.

        Only those months are read and written. A commit by another writer meanwhile is a ``Conflict``:
        what was read may no longer hold.
        """
        v = self.version()
        months = {r[0] for r in self.read(v.number).filter(touched).select(F.date_format(F.trunc("dt", "month"), "yyyy-MM-dd")).distinct().collect()} if v.entries else set()
        if not months:
            return v
        old = self._read_folders([e.folder for e in v.entries if e.month in months], v.schema)
        fresh = self._entries(change(old), v.columns)
        kept = tuple(e for e in v.entries if e.month not in months)
        return self._commit(replace(v, number=v.number + 1, entries=kept + fresh, note=note))

    def delete(self, gone: Column) -> Version:
        """Removes the rows for which ``gone`` holds (null: they stay)."""
        return self.rewrite(lambda old: old.filter(~F.coalesce(gone, F.lit(False))), gone, "delete")

    def restore(self, number: int) -> Version:
        """A new version with the rows of an old one; no data moves."""
        old, head = self.version(number), self.version()
        return self._commit(replace(old, number=head.number + 1, note=f"restore {number}"))

    def vacuum(self, keep: int) -> int:
        """Deletes versions before the last ``keep`` and folders that none of the rest names; how many folders went.

        Not for use while others write: a folder that is not committed yet counts as unused.
        """
        fs, numbers = self._files(), self.versions()
        for n in numbers[:-keep]:
            fs.delete(self._path(f"versions/{n:08d}.json"), False)
        used = {"/".join(e.folder.split("/")[:2]) for n in numbers[-keep:] for e in self.version(n).entries}
        folders = [f"data/{s.getPath().getName()}" for s in fs.listStatus(self._path("data"))] if fs.exists(self._path("data")) else []
        gone = [f for f in folders if f not in used]
        for f in gone:
            fs.delete(self._path(f), True)
        return len(gone)

    # --- reading

    def read(self, version: int | None = None, start: str | None = None, end: str | None = None, codes: list | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of a version (default: the newest) with start <= dt <= end; months outside the range are not opened.

        The returned rows are pinned: later commits do not change them.
        """
        v = self.version(version)
        if not v.schema:
            raise ValueError("the store is empty")
        low = dt.date.fromisoformat(start).replace(day=1).isoformat() if start else ""
        folders = [e.folder for e in v.entries if e.month >= low and (end is None or e.month <= end)]
        schema = ", ".join(x.replace(":", " ", 1) for x in _fields(v.schema))
        df = self._read_folders(folders, v.schema) if folders else self.spark.createDataFrame([], schema)
        if start is not None:
            df = df.filter(F.col("dt") >= F.lit(start).cast("date"))
        if end is not None:
            df = df.filter(F.col("dt") <= F.lit(end).cast("date"))
        if codes is not None:
            df = df.filter(F.col("code").isin(codes))
        return df.select(*columns) if columns else df

    def changes(self, a: int, b: int) -> DataFrame:
        """Rows that only one of two versions holds, with ``side`` (``removed`` or ``added``): reads the changed months alone."""
        va, vb = self.version(a), self.version(b)
        months = set(changed_months(va, vb))
        only = lambda v, other: self._read_folders(folders, v.schema) if (folders := [e.folder for e in v.entries if e.month in months and e not in other.entries]) else self.read(v.number).limit(0)
        left, right = only(va, vb), only(vb, va)
        return left.exceptAll(right).withColumn("side", F.lit("removed")).unionByName(right.exceptAll(left).withColumn("side", F.lit("added")))


def _fields(schema: str) -> list[str]:
    """The fields of a struct's text, parted at commas outside brackets."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now] if now else out
