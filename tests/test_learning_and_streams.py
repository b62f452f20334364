"""Splits keep time order; streams agree with the batch."""

import datetime as dt

from pyspark.sql import functions as F

from alphaloom.operators import learning
from alphaloom.streaming.bars import upsert_sink, windowed_bars


def test_purged_folds_separate_train_and_test(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i),) for i in range(24)], "dt date")
    rows = learning.purged_folds(days, 6, 2, 1).collect()
    assert len(rows) == 15 * 24
    for c in range(15):
        role = {r.dt: r.role for r in rows if r.combination == c}
        for day, what in role.items():
            if what == "train":
                assert all(role.get(day + dt.timedelta(k)) != "test" for k in (-1, 1))


def test_stream_of_events(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed_bars(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    want = events.groupBy("user_id", F.to_date("ts")).agg(F.count(F.lit(1))).collect()
    got = spark.sql("SELECT code, to_date(start) AS d, volume FROM bars").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    q = stream.select("user_id", "event_id", "value").writeStream.foreachBatch(upsert_sink(str(tmp_path / "out"), ["user_id"], "event_id")).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    last = q.lastProgress["batchId"]
    q.stop()
    versions = sorted((tmp_path / "out").glob("v*"), key=lambda p: int(p.name[1:]))
    assert versions and int(versions[-1].name[1:]) <= last + 1
    assert spark.read.parquet(str(versions[-1])).count() == events.select("user_id").distinct().count()
