"""Cleaning, choosing, capacity, stacked models and regimes against planted cases and plain numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from alphaloom.operators import cleaning, learning, regimes, selection

DAY = dt.date(2024, 1, 1)


def cross_section(n=60, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    return pd.DataFrame({"code": range(n), "dt": DAY, "a": a, "b": 2 * a + rng.normal(scale=0.05, size=n), "c": rng.normal(size=n)})


def test_chained_imputation_follows_the_other_factors(spark):
    rows = cross_section()
    truth = rows.loc[:4, "b"].to_numpy(copy=True)
    rows.loc[:4, "b"] = np.nan
    got = cleaning.impute_chained(spark.createDataFrame(rows).replace(float("nan"), None), ["a", "b", "c"]).toPandas().sort_values("code")
    assert np.abs(got["b"].to_numpy()[:5] - truth).max() < 0.4
    assert np.allclose(got["b"].to_numpy()[5:], rows["b"].to_numpy()[5:])


def test_a_factor_without_values_stays_null_and_an_empty_table_empty(spark):
    rows = cross_section().assign(c=np.nan)
    df = spark.createDataFrame(rows).replace(float("nan"), None)
    assert cleaning.impute_chained(df, ["a", "b", "c"]).filter("c is not null").isEmpty()
    for f in (cleaning.impute_chained, cleaning.mask_isolated, cleaning.orthogonalize):
        assert f(df.limit(0), ["a", "b"]).isEmpty()


def test_isolation_masks_planted_outliers_only(spark):
    rows = cross_section()
    rows.loc[[7, 21, 40], ["a", "b", "c"]] = [[30.0, -20, 15], [-25, 30, 20], [28, 28, -30]]
    got = cleaning.mask_isolated(spark.createDataFrame(rows), ["a", "b", "c"], share=0.05).filter("a is null").toPandas()
    assert sorted(got["code"]) == [7, 21, 40]


def test_orthogonal_factors_and_inflation_match_numpy(spark):
    rows = cross_section()
    df = spark.createDataFrame(rows)
    q = cleaning.orthogonalize(df, ["a", "b", "c"]).toPandas()[["a", "b", "c"]].to_numpy()
    gram = q.T @ q
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-9
    got = cleaning.independence(df, ["a", "b", "c"]).first()
    r = np.corrcoef(rows[["a", "b", "c"]].to_numpy().T)
    assert got["mean_vif"] == pytest.approx(np.diag(np.linalg.inv(r)).mean())
    assert got["max_corr"] == pytest.approx(np.abs(r[np.triu_indices(3, 1)]).max())


def test_capacity_lies_between_levels(spark):
    df = spark.createDataFrame([(1e6, 0.10), (1e7, 0.09), (1e8, 0.07)], "capital double, annual double")
    assert selection.capacity(df).first()[0] == pytest.approx(1e7 + 0.5 * 9e7)
    assert selection.capacity(df.filter("capital < 5e7")).first()[0] == 1e7
    assert selection.capacity(df.selectExpr("capital", "-annual as annual")).first()[0] is None


def test_regimes_find_planted_states(spark):
    rng = np.random.default_rng(5)
    state = np.repeat([0, 2, 1, 2, 0], 80)
    x = np.array([-0.03, 0.0, 0.03])[state] + rng.normal(scale=0.006, size=len(state))
    rows = pd.DataFrame({"code": "i", "dt": [DAY + dt.timedelta(k) for k in range(len(x))], "ret": x})
    got = regimes.hidden_regimes(spark.createDataFrame(rows), "ret").toPandas().sort_values("dt")
    assert (got["state"].to_numpy() == state).mean() > 0.97
    short = regimes.hidden_regimes(spark.createDataFrame(rows.head(10)), "ret")
    assert short.count() == 10 and short.filter("state is not null").isEmpty()


def test_scaled_passes_match_the_sum_over_all_paths():
    import itertools

    x, k = np.array([0.1, -0.4, 0.3, 0.2]), 2
    start, move, mean, var = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([-0.2, 0.3]), np.array([0.1, 0.2])
    p = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var)
    total, post = 0.0, np.zeros((4, k))
    for path in itertools.product(range(k), repeat=4):
        w = start[path[0]] * np.prod([move[a, b] for a, b in zip(path, path[1:])]) * np.prod([p[t, s] for t, s in enumerate(path)])
        total += w
        for t, s in enumerate(path):
            post[t, s] += w
    got, moves, fit = regimes._pass(x, start, move, mean, var)
    assert np.allclose(got, post / total) and fit == pytest.approx(np.log(total)) and moves.sum() == pytest.approx(3)


def test_forest_tells_shifted_tables_apart_only(spark):
    rng = np.random.default_rng(2)
    make = lambda m: spark.createDataFrame(pd.DataFrame({"a": rng.normal(m, 1, 600), "b": rng.normal(size=600)}))
    assert learning.adversarial_auc(make(0), make(3), ["a", "b"], trees=5) > 0.9
    assert abs(learning.adversarial_auc(make(0), make(0), ["a", "b"], trees=5) - 0.5) < 0.15
