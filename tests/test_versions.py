"""The versioned store: crashes between any two steps, repeated batches, concurrent writers, time travel, digests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from alphaloom.sources.versions import Conflict, VersionedStore, changed_months, digests


def rows(spark, *days, codes=range(4)):
    return spark.createDataFrame([(c, dt.date.fromisoformat(x), c + 0.5) for x in days for c in codes], "code int, dt date, close double").repartition(3)


def held(df):
    return sorted((r.code, r.dt.isoformat(), r.close) for r in df.collect())


class Stop(Exception):
    pass


def stop_at(n):
    seen = []

    def step(name):
        seen.append(name)
        if len(seen) == n:
            raise Stop(name)

    step.seen = seen
    return step


@pytest.mark.parametrize("n", range(1, 5))
@pytest.mark.parametrize("change", ["append", "delete"])
def test_a_crash_leaves_the_old_or_the_new_version(spark, tmp_path, n, change):
    path = str(tmp_path / "t")
    first, more = rows(spark, "2020-01-05", "2020-02-10"), rows(spark, "2020-02-11", "2020-03-01")
    store = VersionedStore(spark, path)
    store.append(first, "a")
    act = (lambda s: s.append(more, "b")) if change == "append" else (lambda s: s.delete(F.expr("dt < date'2020-02-01' or code = 3")))
    old = held(first)
    new = sorted(held(first) + held(more)) if change == "append" else [r for r in old if r[1] > "2020-02" and r[0] != 3]
    with pytest.raises(Stop):
        act(VersionedStore(spark, path, step=stop_at(n)))
    after = held(VersionedStore(spark, path).read())
    assert after == (new if n == 4 else old)
    act(VersionedStore(spark, path))  # the same step again
    assert held(store.read()) == new and held(store.read(1)) == old


def test_batches_count_once_and_versions_stay(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        store.read()
    a, b = rows(spark, "2020-01-05"), rows(spark, "2020-01-06", "2021-01-01")
    assert store.append(a, "a").number == 1 and store.append(a, "a").number == 1 and store.append(b, "b").number == 2
    pinned = store.read(1)
    store.delete(F.lit(True))
    assert held(store.read()) == [] and store.version().number == 3
    assert held(pinned) == held(store.read(1)) == held(a) and held(store.read(2, "2020-02-01")) == held(rows(spark, "2021-01-01"))
    assert store.delete(F.lit(True)).number == 3  # nothing to do, no version
    assert held(store.read(store.restore(2).number, codes=[1], end="2020-12-31")) == held(rows(spark, "2020-01-05", "2020-01-06", codes=[1]))
    assert store.vacuum(1) == 1 and store.versions() == [4]
    with pytest.raises(KeyError):
        store.read(1)
    with pytest.raises(ValueError):
        store.append(a.withColumn("more", F.lit(1)), "c")


def test_two_writers_both_count(spark, tmp_path):
    path = str(tmp_path / "t")
    VersionedStore(spark, path).append(rows(spark, "2020-01-01"), "a")
    other = VersionedStore(spark, path)
    raced = []

    def race(name):
        if name == "manifest written" and not raced:
            raced.append(other.append(rows(spark, "2020-01-02"), "other").number)

    mine = VersionedStore(spark, path, step=race).append(rows(spark, "2020-01-03"), "mine")
    assert raced == [2] and mine.number == 3 and held(other.read()) == held(rows(spark, "2020-01-01", "2020-01-02", "2020-01-03"))
    raced.clear()

    def race_again(name):
        if name == "manifest written" and not raced:
            raced.append(other.append(rows(spark, "2020-01-04"), "late").number)

    with pytest.raises(Conflict):  # a delete read what is no longer the newest
        VersionedStore(spark, path, step=race_again).delete(F.expr("code = 0"))
    assert len(held(other.read())) == 16


def test_digests_ignore_order_and_name_the_month(spark, tmp_path):
    df = rows(spark, "2020-01-05", "2020-02-10", "2021-03-01").unionByName(rows(spark, "2020-01-05", codes=[1]))
    month = F.date_format("dt", "yyyy-MM")
    one = {r.part: tuple(r) for r in digests(df, ["code", "dt", "close"], month).collect()}
    assert one == {r.part: tuple(r) for r in digests(df.orderBy("close").repartition(7), ["code", "dt", "close"], month).collect()}
    changed = df.withColumn("close", F.when((F.col("code") == 2) & (F.col("dt") == F.lit("2020-02-10").cast("date")), 9.0).otherwise(F.col("close")))
    other = {r.part: tuple(r) for r in digests(changed, ["code", "dt", "close"], month).collect()}
    assert [p for p in one if one[p] != other[p]] == ["2020-02"]
    a, b = VersionedStore(spark, str(tmp_path / "a")), VersionedStore(spark, str(tmp_path / "b"))
    va = a.append(df, "all")
    b.append(df.filter("code < 2"), "low")
    vb = b.append(df.filter("code >= 2"), "high")
    assert va.root() == vb.root() and changed_months(va, vb) == []  # other folders and batches, the same rows
    vc = b.delete(F.expr("code = 2 and dt = date'2020-02-10'"))
    assert changed_months(va, vc) == ["2020-02-01"]
    assert [tuple(r) for r in b.changes(vb.number, vc.number).collect()] == [(2, dt.date(2020, 2, 10), 2.5, "removed")]


def test_halves_of_a_hash_are_cut_in_whole_numbers(spark):
    """These rows' hashes lie 8 and 23 below a multiple of 2^30, which a quotient in doubles rounds up."""
    kept = [(16223463, 1632697, "P", "1999-08-25", 1089767239260831736), (23632399, 2362901, "P", "1997-07-27", 753872177199054825)]
    df = spark.createDataFrame(kept, "a long, b long, c string, d string, h long")
    got = {r.part: (r.low, r.high, r.mix) for r in digests(df, ["a", "b", "c", "d"], "a").collect()}
    assert got == {r[0]: (r[4] % 2**30, r[4] // 2**30, r[4]) for r in kept}


def test_a_large_month_is_several_files(spark, tmp_path):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # these rows are few enough to be joined into one file
    try:
        store = VersionedStore(spark, str(tmp_path / "t"))
        store.append(spark.range(200_000).selectExpr("cast(id as int) code", "date'2020-01-05' dt", "id * 0.5D close"), "a")
    finally:
        spark.conf.set(name, before)
    assert len(list((tmp_path / "t").rglob("*.parquet"))) > 1 and store.read(codes=[77]).count() == 1
