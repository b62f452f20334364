"""Operators on small tables against pandas and hand-made cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.functions.columns import average_rank, clip, safe_divide
from alphaloom.operators import flows, fundamentals, market_data, pit, portfolio, preprocess, price, research
from alphaloom.sources.tables import upsert


@pytest.fixture(scope="module")
def frame():
    r = np.random.RandomState(42)
    days = pd.date_range("2024-01-01", periods=60).date
    rows = [(c, d, float(10 + r.rand() * 5), float(r.randint(1, 100))) for c in range(4) for d in days]
    return pd.DataFrame(rows, columns=["code", "dt", "close", "volume"])


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_divide("a", "b")).collect()] == [None, 0.5, None]
    assert [r[0] for r in df.select(clip("a", 2.0, 3.0)).collect()] == [2.0, 2.0, None]


def test_average_rank(spark):
    values = [3.0, 1.0, 3.0, None, 2.0]
    df = spark.createDataFrame([(1, v) for v in values], "dt int, x double").withColumn("r", average_rank("x"))
    got = sorted((r["x"] is None, r["x"] or 0, r["r"]) for r in df.collect())
    assert got == [(False, 1.0, 1.0), (False, 2.0, 2.0), (False, 3.0, 3.5), (False, 3.0, 3.5), (True, 0, None)]


def test_ema_family_matches_pandas(spark, frame):
    got = price.ema_family(spark.createDataFrame(frame)).toPandas().sort_values(["code", "dt"])
    close = frame[frame.code == 2].close
    dif = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    want = (dif - dif.ewm(span=9, adjust=False).mean()) / close * 100
    assert np.allclose(got[got.code == 2].macd_signal, want)
    rsi = got[got.code == 2].rsi.dropna()
    assert len(rsi) == 46 and rsi.between(0, 100).all()


def test_rank_normal_is_symmetric(spark, frame):
    got = preprocess.standardize(spark.createDataFrame(frame), "close", "rank_normal").groupBy("dt").agg(F.sum("close").alias("s")).toPandas()
    assert np.allclose(got.s, 0, atol=1e-9)


def test_residual_is_orthogonal(spark):
    r = np.random.RandomState(1)
    df = pd.DataFrame({"code": range(50), "dt": dt.date(2024, 1, 1), "y": r.rand(50), "a": r.rand(50), "b": r.rand(50)})
    got = preprocess.residual(spark.createDataFrame(df), "y", ["a", "b"]).toPandas().sort_values("code").residual
    assert abs(got @ df.a) < 1e-9 and abs(got.sum()) < 1e-9


def test_pit_has_no_look_ahead(spark):
    d = dt.date
    rows = [(1, d(2024, 3, 31), d(2024, 4, 10), 1, 1, 5.0), (1, d(2024, 3, 31), d(2024, 4, 20), 3, 1, 7.0), (1, d(2024, 3, 31), d(2024, 5, 20), 3, 2, 9.0)]
    filings = spark.createDataFrame(rows, "code int, end_date date, ann_date date, source_priority int, revision_no int, net_profit double")
    assert [r["net_profit"] for r in pit.known_at(filings, "2024-04-15").collect()] == [5.0]
    assert [r["net_profit"] for r in pit.known_at(filings, "2024-05-01").collect()] == [7.0]
    days = spark.createDataFrame([(1, d(2024, 4, 1)), (1, d(2024, 4, 20)), (2, d(2024, 6, 1))], "code int, dt date")
    got = {(r["code"], r["dt"]): r["net_profit"] for r in pit.as_of(days, filings, "net_profit").collect()}
    assert got == {(1, d(2024, 4, 1)): None, (1, d(2024, 4, 20)): 7.0, (2, d(2024, 6, 1)): None}


def test_psi_and_ks_of_equal_samples(spark, frame):
    df = spark.createDataFrame(frame)
    assert research.psi(df, df, "close").first()[0] == 0
    assert research.ks(df, df, "close").first()[0] == 0
    shifted = df.withColumn("close", F.col("close") + 100)
    assert research.ks(df, shifted, "close").first()[0] == 1


def test_cleaning(spark):
    d = [dt.date(2024, 1, k) for k in (1, 2, 3)]
    rows = [
        (1, d[0], "600001.SH", 1.0, 2.0, 0.5, 1.5, 10, 7.0, 1), (1, d[0], "600001.SH", 1.0, 2.0, 0.5, 1.6, 20, None, 2),  # delivered twice: the last stays, whatever its volume
        (1, d[1], "600001.SH", 1.6, 1.8, 1.5, 1.78, 5, 9.0, 3), (1, d[2], "600001.SH", 1.78, 1.78, 1.78, 1.78, 0, None, 4),
        (2, d[0], "300002.SZ", 1.0, 0.9, 0.5, 1.0, 10, None, 5), (2, d[1], "300002.SZ", 1.1, 1.2, 1.1, 1.2, 10, 3.0, 6), (2, d[2], "300002.SZ", 1.2, 1.5, 1.1, 1.45, 10, None, 7),
        (3, d[0], "600003.SH", 1.0, 2.0, 0.5, None, 10, 1.0, 8), (4, d[0], "600004.SH", 1.0, 2.0, 0.5, 1.0, -1, 1.0, 9), (4, d[1], "600004.SH", -1.0, 2.0, 0.5, 1.0, 1, 1.0, 10),
    ]
    bars = spark.createDataFrame(rows, "code int, dt date, ts_code string, open double, high double, low double, close double, volume int, amount double, seq int")
    got = market_data.clean(bars).orderBy("code", "dt").collect()
    assert [(r["code"], r["dt"], r["close"], r["amount"], r["ohlc_flag"], r["limit_flag"], r["suspended"]) for r in got] == [
        (1, d[0], 1.6, None, False, False, False), (1, d[1], 1.78, 9.0, False, True, False), (1, d[2], 1.78, 9.0, False, False, True),
        (2, d[0], 1.0, None, True, False, False), (2, d[1], 1.2, 3.0, False, False, False), (2, d[2], 1.45, 3.0, False, True, False),
    ]
    codes = market_data.clean_codes(spark.createDataFrame([(" 000001.sz ",), ("830001.SZ",), ("abc",)], "ts_code string"))
    assert [r[0] for r in codes.collect()] == ["000001.SZ"]


def test_a_late_restatement_replaces_no_newer_period(spark):
    d = dt.date
    rows = [(1, d(2024, 3, 31), d(2024, 4, 10), 3, 1, 5.0), (1, d(2024, 6, 30), d(2024, 7, 10), 3, 1, 8.0), (1, d(2024, 3, 31), d(2024, 8, 1), 3, 2, 6.0), (1, d(2024, 6, 30), d(2024, 8, 5), 1, 9, 1.0)]
    filings = spark.createDataFrame(rows, "code int, end_date date, ann_date date, source_priority int, revision_no int, net_profit double")
    days = spark.createDataFrame([(1, x) for x in (d(2024, 5, 1), d(2024, 7, 15), d(2024, 9, 1))], "code int, dt date")
    assert [r["net_profit"] for r in pit.as_of(days, filings, "net_profit").orderBy("dt").collect()] == [5.0, 8.0, 8.0]


def test_expired_intervals_hide_none_that_is_open(spark):
    d = dt.date
    spans = spark.createDataFrame([(1, d(2024, 1, 1), None, 10), (1, d(2024, 2, 1), d(2024, 3, 1), 20), (1, d(2024, 4, 1), None, 5), (1, d(2024, 4, 1), None, 7), (1, d(2024, 5, 1), d(2024, 5, 1), 9), (2, d(2024, 1, 1), d(2024, 2, 1), 1)], "code int, effective date, expire date, cls int")
    days = spark.createDataFrame([(1, d(2023, 12, 31)), (1, d(2024, 1, 1)), (1, d(2024, 2, 29)), (1, d(2024, 3, 1)), (1, d(2024, 6, 1)), (2, d(2024, 2, 1)), (3, d(2024, 1, 1))], "code int, dt date")
    got = flows.valid_at(spans, days, "cls").orderBy("code", "dt").collect()
    assert [r["cls"] for r in got] == [None, 10, 20, 10, 7, None, None]


def test_changed_contents_break_the_chain(spark):
    log = spark.createDataFrame([(i, f"entry {i}") for i in range(6)], "seq long, entry string").withColumn("hash", F.sha2("entry", 256))
    chained = market_data.chain(log)
    assert all(r["valid"] for r in market_data.verify_chain(chained).collect())
    changed = chained.withColumn("entry", F.when(F.col("seq") == 3, F.lit("forged")).otherwise(F.col("entry")))
    assert [r["seq"] for r in market_data.verify_chain(changed).filter("not valid").collect()] == [3]
    rehashed = changed.withColumn("hash", F.sha2("entry", 256))
    assert [r["seq"] for r in market_data.verify_chain(rehashed).filter("not valid").collect()] == [4]


def test_current_ratio_divides_current_assets(spark):
    row = {c: 1.0 for c in ("net_profit", "equity", "equity_prev", "assets", "assets_prev", "gross_profit", "goodwill")} | {"revenue": 100.0, "current_assets": 6.0, "current_liabilities": 4.0}
    assert fundamentals.quality(spark.createDataFrame([row])).first()["current_ratio"] == 1.5


def test_upsert(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(2, 1, "c"), (3, 1, "d")], "k int, v int, x string")
    assert sorted(tuple(r) for r in upsert(old, new, ["k"], "v").collect()) == [(1, 1, "a"), (2, 1, "c"), (3, 1, "d")]


def test_optimisers():
    r = np.random.RandomState(3)
    x = r.rand(200, 6)
    cov = np.cov(x.T)
    w = portfolio.minimum_variance(cov, 0.4)
    assert abs(w.sum() - 1) < 1e-6 and w.max() <= 0.4 + 1e-9 and w @ cov @ w <= np.full(6, 1 / 6) @ cov @ np.full(6, 1 / 6) + 1e-12
    p = portfolio.risk_parity(cov)
    share = p * (cov @ p) / (p @ cov @ p)
    assert np.allclose(share, 1 / 6, atol=1e-6)


def test_imports_without_the_training_data_operators():
    import pathlib

    for path in pathlib.Path("alphaloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "alphaloom.llm" not in path.read_text()
