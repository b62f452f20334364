"""Simulated losses against closed forms, any partitioning alike; mined formulas against trying everything."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from alphaloom.operators import mining, scenarios

DAY = dt.date(2020, 1, 1)
COV = np.array([[0.04, 0.01, 0.0], [0.01, 0.02, -0.005], [0.0, -0.005, 0.01]])


@pytest.fixture(scope="module")
def cov(spark):
    return spark.createDataFrame([("abc"[i], "abc"[j], float(COV[i, j])) for i in range(3) for j in range(3)], "a string, b string, cov double")


def test_normal_losses_have_their_closed_form(spark, cov):
    x = {"p": [1.0, 0.5, -1.0], "q": [0.0, 2.0, 0.3]}
    own = {"p": 0.01, "q": 0.0}
    rows = [(p, "abc"[i], v) for p, e in x.items() for i, v in enumerate(e)] + [("p", None, own["p"])]
    exposures = spark.createDataFrame(rows, "portfolio string, factor string, x double")
    n = 40_000
    losses = scenarios.scenario_losses(exposures, cov, n)
    for r in scenarios.tail(losses, 0.99).collect():
        sd = math.sqrt(np.array(x[r.portfolio]) @ COV @ np.array(x[r.portfolio]) + own[r.portfolio])
        z = NormalDist().inv_cdf(0.99)
        density = NormalDist().pdf(z)
        error = math.sqrt(0.99 * 0.01 / n) / density * sd  # of a sample quantile
        assert r.scenarios == n and abs(r["var"] - z * sd) < 5 * error and abs(r.mean) < 5 * sd / math.sqrt(n) and abs(r.sd / sd - 1) < 0.02
        assert abs(r.es - density / 0.01 * sd) < 0.08 * sd and r.worst >= r.es >= r["var"]


def test_partitioning_changes_no_draw(spark, cov):
    exposures = spark.createDataFrame([("p", "a", 1.0), ("p", "c", 2.0), ("q", "b", 1.0), ("q", None, 0.5)], "portfolio string, factor string, x double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    one = rows(scenarios.scenario_losses(exposures, cov, 300, 7))
    assert one == rows(scenarios.scenario_losses(exposures.repartition(7), cov.repartition(3), 300, 7)) and len(one) == 600
    assert one != rows(scenarios.scenario_losses(exposures, cov, 300, 8))
    assert scenarios.tail(scenarios.scenario_losses(exposures.limit(0), cov, 10)).count() == 0
    singular = spark.createDataFrame([(a, b, 1.0) for a in "ab" for b in "ab"], "a string, b string, cov double")
    assert scenarios.factor_root(singular)[0] == ["a", "b"]


def test_liquidity_adds_its_costs(spark):
    rows = [("a", 0.001, 0.02, 1e6, 4e6), ("b", 0.0, 0.01, 1e6, 0.0), ("c", None, 0.01, None, 1e6)]
    got = {r.code: r for r in scenarios.liquidity_adjusted(spark.createDataFrame(rows, "code string, mean double, sd double, position double, daily_volume double")).collect()}
    var = -(0.001 + NormalDist().inv_cdf(0.05) * 0.02)
    assert got["a"].lvar == pytest.approx(var + 0.0005 + 0.1 * 0.5) and got["b"].impact_cost == 0 and got["c"].lvar is None and got["c"].participation == 0


@pytest.fixture(scope="module")
def planted(spark):
    r = np.random.default_rng(11)
    rows = []
    for t in range(24):
        for c in range(30):
            a, b, e = (float(v) for v in r.normal(size=3))
            rows.append((c, DAY + dt.timedelta(t), a, b, None if c == 7 else e, a * b + 0.3 * float(r.normal()) if t % 11 else None))
    return spark.createDataFrame(rows, "code int, dt date, a double, b double, e double, y double").repartition(4).cache()


def test_the_planted_formula_is_found_and_pruning_loses_nothing(planted):
    formulas = mining.grammar(["a", "b", "e"], 1)
    assert len(formulas) == len({f.name for f in formulas}) == 3 + 9 + 3 + 6 + 6
    got = mining.mine(planted, formulas, "y", best=3, blocks=6)
    everything = mining.mine(planted, formulas, "y", best=3, blocks=1)
    assert got[0][0] == "mul(a,b)" and got[0][1] > 0.8
    assert [(n, round(ic, 9), d) for n, ic, d, _ in got] == [(n, round(ic, 9), d) for n, ic, d, _ in everything]


def test_hopeless_formulas_are_dropped_early(planted, monkeypatch):
    seen = []
    inner = mining.block_ics
    monkeypatch.setattr(mining, "block_ics", lambda df, fs, *a: seen.append(len(fs)) or inner(df, fs, *a))
    mining.mine(planted, mining.grammar(["a", "b", "e"], 1), "y", best=1, blocks=6)
    assert seen[0] == 27 and seen[-1] < 15


def test_shared_parts_are_one_column(planted):
    ab = mining.Formula("mul", (mining.Formula("a"), mining.Formula("b")))
    formulas = [mining.Formula("rank", (ab,)), mining.Formula("delta", (ab,)), ab]
    wide, of = mining.evaluate(planted, formulas, ["code", "dt", "a", "b"])
    rows = wide.filter("code = 3").orderBy("dt").collect()
    assert all(abs(r[of[ab]] - r.a * r.b) < 1e-12 for r in rows)
    assert all(abs(y[of[formulas[1]]] - (y.a * y.b - x.a * x.b)) < 1e-12 for x, y in zip(rows, rows[1:])) and rows[0][of[formulas[1]]] is None
    assert mining.mine(planted.limit(0), formulas, "y") == [(n, 0.0, 0, 0) for n in sorted((f.name for f in formulas), key=lambda n: (len(n), n))]
