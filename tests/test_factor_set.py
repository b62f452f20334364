"""The factor run's cross sections as whole arrays: against the windows of ``preprocess``, and as one row a key in the store."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators import factor_set as fs
from alphaloom.operators import preprocess
from alphaloom.plans import factor_run
from alphaloom.sources.tables import whole

DAY = dt.date(2020, 1, 1)


def by_windows(factors, dims, coverage=0.5):
    """One row a key and factor, by windows over a date and factor."""
    tall = factors.join(dims, "code").unpivot(["code", "dt", "industry", "cap"], list(fs.FACTORS), "factor", "x")
    tall = tall.withColumn("_c", F.avg(F.col("x").isNotNull().cast("double")).over(W.partitionBy("dt", "factor"))).filter(F.col("_c") >= coverage)
    keyed = tall.withColumn("day", F.col("dt")).withColumn("dt", F.struct("day", "factor"))
    clipped = preprocess.winsorize(preprocess.fill(keyed, "x"), "x").withColumn("_sd", F.stddev_samp("x").over(W.partitionBy("dt")))
    neutral = preprocess.neutralize_industry_cap(clipped, "x").withColumn("x", F.when(F.abs("x") > 1e-9 * F.coalesce("_sd", F.lit(0.0)), F.col("x")).when(F.col("x").isNotNull(), 0.0))
    return preprocess.standardize(neutral, "x").filter("x is not null").select("code", F.col("day").alias("dt"), "factor", "x")


@pytest.fixture(scope="module")
def odd(spark):
    """Dates of 1, 2, 3, 40 and 60 rows; constant, sparse, half-known, heavy-tailed and tied factors; unknown industries and sizes."""
    r = np.random.default_rng(5)
    rows = []
    for t, n in enumerate((1, 2, 3, 40, 60)):
        for c in range(n):
            x = r.standard_t(2, len(fs.FACTORS)).tolist()
            x[0], x[1], x[2], x[3], x[4] = 1.0, x[1] if c % 3 == 0 else None, x[2] if c % 2 == 0 else None, float(c % 4), float(c == 7)
            rows.append((c, DAY + dt.timedelta(t), 0.5 if c % 5 else None, *x))
    names = ", ".join(f"{f} double" for f in fs.FACTORS)
    factors = spark.createDataFrame(rows, f"code long, dt date, label double, {names}")
    dims = spark.createDataFrame([(c, c % 7 if c % 11 else None, None if c == 13 else 0.0 if c == 17 else math.exp(float(r.normal()))) for c in range(55)], "code long, industry int, cap double")
    return factors, dims


def test_cross_sections_equal_windows(spark, odd):
    factors, dims = odd
    got = fs.processed(factors, dims)
    assert got.columns == ["code", "dt", "label", *fs.FACTORS]  # a row a key, not a row a factor
    held = {(r.code, r.dt): r for r in got.collect()}
    assert len(held) == 1 + 2 + 3 + 40 + 55 and held[6, DAY + dt.timedelta(4)].label == 0.5 and held[5, DAY + dt.timedelta(4)].label is None
    want = {(r.code, r.dt, r.factor): r.x * fs.FACTORS[r.factor][1] for r in by_windows(factors, dims).collect()}
    known = {(*key, f): row[f] for key, row in held.items() for f in fs.FACTORS if row[f] is not None}
    assert known.keys() == want.keys()
    assert all(known[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


def test_scores_by_hand(spark):
    first, *rest = fs.FACTORS
    second, none = rest[0], ", ".join(f"cast(null as double) {f}" for f in rest[1:])
    days = [DAY + dt.timedelta(t) for t in range(5)]
    values = spark.createDataFrame([(1, days[4], 2.0, 4.0), (2, days[4], None, 4.0), (3, days[4], None, None), (1, days[0], 1.0, 2.0)], f"code int, dt date, {first} double, {second} double").selectExpr("*", *none.split(", "))
    ics = spark.createDataFrame([(f, d, 20, ic) for d in days for f, ic in ((first, 0.3), (second, -0.1))], "factor string, dt date, n long, ic double")
    got = {(r.code, r.dt): r.score for r in fs.scores(values, ics).collect()}
    assert got == {(1, days[4]): pytest.approx(2.0 * 0.75 - 4.0 * 0.25), (2, days[4]): pytest.approx(-4.0), (1, days[0]): pytest.approx(1.5)}


def test_stored_run_is_one_row_a_key(spark, sf):
    store = factor_run.stored_values(spark, sf)[1]
    rows = store.read()
    assert set(rows.columns) == {"code", "dt", "label", *fs.FACTORS} and rows.count() == rows.select("code", "dt").distinct().count()
    months = {e.month: e.digest.n for e in store.version().entries}
    assert {str(r["m"]): r["count"] for r in rows.groupBy(F.trunc("dt", "month").alias("m")).count().collect()} == months


def test_whole_numbers_round_as_decimals_do(spark):
    x = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 1e15 + 0.5, 2.0**52 + 1, -0.2, 0.0, 114.99999999999999, 12345678.5, None]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", whole(F.col("x")).cast("long").alias("a"), F.round("x").cast("long").alias("b")).collect()
    assert all(r.a == r.b for r in rows) and rows[0].a == 1 and rows[1].a == -1 and rows[5].a == 0
