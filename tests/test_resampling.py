"""Resampled tests, stacked models and orthogonal factors against what defines them."""

import datetime as dt
import math
from statistics import NormalDist, fmean, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import exposure, learning, simulation, weighting


@pytest.fixture(scope="module")
def returns(spark):
    r = np.random.default_rng(4).normal(0.001, 0.02, 43)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(r)]
    return spark.createDataFrame(rows, "dt date, ret double").repartition(3), r


def keyed(spark, draws, blocks):
    keys = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(spark.range(blocks).withColumnRenamed("id", "b"))
    return {(x["draw"], x["b"]): x["h"] for x in keys.withColumn("h", F.xxhash64(F.lit(7), "draw", "b")).collect()}


def test_block_bootstrap(spark, returns):
    df, r = returns
    n, block, draws = len(r), 5, 20
    h = keyed(spark, draws, (n - 1) // block + 1)
    got = {x["draw"]: (x["mean"], x["sharpe"]) for x in simulation.block_bootstrap(df, draws=draws, block=block).collect()}
    for d in range(draws):
        x = [r[(h[d, i // block] % n + i % block) % n] for i in range(n)]
        assert got[d][0] == pytest.approx(fmean(x)) and got[d][1] == pytest.approx(fmean(x) / stdev(x) * math.sqrt(252))
    low, high = simulation.confidence_interval(simulation.block_bootstrap(df, draws=draws, block=block)).first()
    assert low == pytest.approx(np.quantile([s for _, s in got.values()], 0.025)) and high == pytest.approx(np.quantile([s for _, s in got.values()], 0.975))


def test_sign_permutation(spark, returns):
    df, r = returns
    draws, block = 50, 5
    h = keyed(spark, draws, (len(r) - 1) // block + 1)
    means = [np.mean([x if h[d, i // block] % 2 == 0 else -x for i, x in enumerate(r)]) for d in range(draws)]
    observed, p = simulation.sign_permutation_test(df, draws=draws, block=block).first()
    assert observed == pytest.approx(r.mean()) and p == pytest.approx((sum(m >= r.mean() - 1e-15 for m in means) + 1) / (draws + 1))


def test_deflated_sharpe(spark):
    s, n, skew, kurt, trials = 0.12, 240, -0.4, 4.2, 20
    out = simulation.deflated_sharpe(spark.createDataFrame([(s, n, skew, kurt)], "sharpe double, n long, skew double, kurt double"), trials).first()
    inv, gamma = NormalDist().inv_cdf, 0.5772156649015329
    best = ((1 - gamma) * inv(1 - 1 / trials) + gamma * inv(1 - 1 / (trials * math.e))) / math.sqrt(n)
    z = (s - best) * math.sqrt(n - 1) / math.sqrt(1 - skew * s + (kurt - 1) / 4 * s * s)
    assert out["deflated"] == pytest.approx(NormalDist().cdf(z)) and out["least_years"] == pytest.approx((inv(0.95) / (s * math.sqrt(252))) ** 2)


def test_stacked_predictions_never_saw_their_block(spark):
    r = np.random.default_rng(5)
    rows = [(c, dt.date(2024, 1, 1) + dt.timedelta(days=t), *map(float, r.normal(size=2))) for t in range(9) for c in range(12)]
    df = spark.createDataFrame(rows, "code long, dt date, a double, b double").withColumn("y", F.col("a") - 0.5 * F.col("b"))
    first = F.col("dt") < F.lit("2024-01-04").cast("date")
    changed = df.withColumn("y", F.when(first, F.lit(99.0)).otherwise(F.col("y")))
    one, two = ({(x.code, x.dt): (x.ridge, x.boosted) for x in learning.stacked(t, ["a", "b"], "y").filter(first).collect()} for t in (df, changed))
    assert len(one) == 36 and one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    good = learning.stacked(df, ["a", "b"], "y").join(df.select("code", "dt", "y"), ["code", "dt"])
    assert good.select(F.corr("stacked", "y")).first()[0] > 0.9


@pytest.fixture(scope="module")
def factors(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 3)) @ np.array([[1, 0.6, 0.3], [0, 1, 0.5], [0, 0, 1]]) * [1, 5, 0.1] + [3, -2, 1]
    return spark.createDataFrame([(i, dt.date(2024, 1, 1), *map(float, v)) for i, v in enumerate(x)], "code long, dt date, a double, b double, c double"), x


def test_symmetric_orthogonalisation(factors):
    df, x = factors
    got = weighting.orthogonalize_symmetric(df, ["a", "b", "c"]).orderBy("code").toPandas()[["a", "b", "c"]].to_numpy()
    assert np.allclose(np.corrcoef(got.T), np.eye(3), atol=1e-8) and np.allclose(got.std(axis=0), 1)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    u, _, vt = np.linalg.svd(z, full_matrices=False)  # the nearest orthogonal matrix is the polar factor
    assert np.allclose(got, u @ vt * np.sqrt(len(x)), atol=1e-6)


def test_principal_components(factors):
    df, x = factors
    got = weighting.principal_components(df, ["a", "b", "c"], 0.999).orderBy("code").toPandas()[["pc1", "pc2", "pc3"]].to_numpy()
    value = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert np.allclose(got.var(axis=0), value) and np.allclose(np.cov(got.T, ddof=0), np.diag(value), atol=1e-8)
    assert len(weighting.principal_components(df, ["a", "b", "c"], value[0] / 3 - 1e-6).columns) == 3


def test_orthogonal_subset_is_greedy():
    icir = {"a": 0.9, "b": 0.85, "c": 0.4, "d": 0.3}
    corr = {frozenset("ab"): 0.8, frozenset("ac"): 0.5, frozenset("ad"): 0.0, frozenset("cd"): 0.1, frozenset("bc"): 0.0, frozenset("bd"): 0.0}
    assert weighting.orthogonal_subset(icir, corr, 3) == ["a", "d", "c"]


def test_student_and_simulated_value_at_risk(spark):
    for p, df, want in ((0.05, 5, -2.015048), (0.01, 10, -2.763769), (0.025, 3, -3.182446), (0.05, 1000, -1.646379)):
        assert exposure.t_quantile(p, df) == pytest.approx(want, abs=2e-4)
    r = np.random.default_rng(9).normal(0.0, 0.02, 500)
    out = exposure.simulated_var(spark.createDataFrame([(1, float(x)) for x in r], "code long, ret double"), "ret").first()
    assert out["normal"] == pytest.approx(1.645 * r.std(ddof=1) - r.mean(), rel=0.03) and out["student"] == pytest.approx(out["normal"], rel=0.15)
