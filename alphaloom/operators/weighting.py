"""Weights of factors from their IC history, and the choice of factors by IC, coverage and correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import average_rank, correlation


def factor_ics(df: DataFrame, factors: list[str], label: str, least: int = 10) -> DataFrame:
    """factor, dt, n, ic: Pearson IC of each factor with the label per date, over rows where both are known."""
    tall = df.select("dt", F.col(label).alias("_y"), *factors).unpivot(["dt", "_y"], factors, "factor", "x").filter("x is not null and _y is not null")
    ics = tall.groupBy("factor", "dt").agg(F.count(F.lit(1)).alias("n"), correlation("x", "_y", least).alias("ic"))
    return ics.filter("ic is not null")


def rolling_ic_weights(ics: DataFrame, n: int = 12, least: int = 3, method: str = "icir") -> DataFrame:
    """dt, factor, weight: of each date, from the ICs of the ``n`` dates before it (the IC of a date is known only after it).

    ``icir`` (the mean on its deviation) and ``ic`` (the mean): negative ones weigh nothing, and a date's weights
    sum to 1. ``signed``: the mean with its sign, absolute weights sum to 1. Where all are 0: equal shares.
    """
    w = W.partitionBy("factor").orderBy("dt").rowsBetween(-n, -1)
    mean, sd = F.avg("ic").over(w), F.stddev_samp("ic").over(w)
    raw = F.when(sd > 1e-12, mean / sd) if method == "icir" else mean
    known = ics.withColumn("_w", F.when(F.count("ic").over(w) >= least, raw if method == "signed" else F.greatest(raw, F.lit(0.0)))).filter("_w is not null")
    day = W.partitionBy("dt")
    total = F.sum(F.abs("_w")).over(day)
    return known.select("dt", "factor", F.when(total > 0, F.col("_w") / total).otherwise(1 / F.count(F.lit(1)).over(day)).alias("weight"))


def ic_weighted_score(df: DataFrame, weights: DataFrame, factors: list[str]) -> DataFrame:
    """code, dt, score: the date's weights over the factors that a row knows.

    Weights may be negative: a factor then counts against its direction. Where the known factors weigh nothing
    at all, the score is their plain mean.
    """
    tall = df.select("code", "dt", *factors).unpivot(["code", "dt"], factors, "factor", "x").filter("x is not null")
    met = tall.join(weights, ["dt", "factor"])
    return met.groupBy("code", "dt").agg((F.coalesce(F.try_divide(F.sum(F.col("x") * F.col("weight")), F.sum(F.abs("weight"))), F.avg("x"))).alias("score"))


def evaluate_features(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, ic (rank IC over all dates' mean), coverage, max_corr (largest absolute correlation with another), importance: one row a feature."""
    tall = df.select("code", "dt", F.col(label).alias("_y"), *features).unpivot(["code", "dt", "_y"], features, "feature", "x")
    both = tall.filter("x is not null and _y is not null")
    ranked = both.withColumns({"_a": average_rank("x", "feature", "dt"), "_b": average_rank("_y", "feature", "dt")})
    ics = ranked.groupBy("feature", "dt").agg(correlation("_a", "_b", 10).alias("ic")).groupBy("feature").agg(F.avg("ic").alias("ic"))
    cover = tall.groupBy("feature").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("coverage"))
    pairs = correlation_pairs(df, features)
    most = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr", "n")).groupBy(F.col("a").alias("feature")).agg(F.max(F.abs("corr")).alias("max_corr"))
    out = cover.join(ics, "feature", "left").join(most, "feature", "left").withColumn("max_corr", F.coalesce("max_corr", F.lit(0.0)))
    return out.withColumn("importance", F.abs("ic") * F.col("coverage") * (1 - 0.5 * F.col("max_corr")))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, corr of each two columns over rows where both are known: one pass, one row of aggregates."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    row = df.agg(*(F.struct(F.count(F.when(k, 1)).alias("n"), correlation(a, b).alias("corr")).alias(f"_{i}") for i, ((a, b), k) in enumerate(zip(pairs, both))))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}.n").alias("n"), F.col(f"_{i}.corr").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(cells).alias("c")).select("c.*")


def redundant(pairs: DataFrame, ics: DataFrame, most: float = 0.7) -> DataFrame:
    """a, b, corr, dropped of pairs correlated beyond ``most``: the one of the smaller absolute IC goes (ties: b)."""
    ic = ics.select("feature", F.abs("ic").alias("ic"))
    met = pairs.filter(F.abs("corr") > most).join(ic.toDF("a", "ia"), "a").join(ic.toDF("b", "ib"), "b")
    return met.select("a", "b", "corr", F.when(F.coalesce("ia", F.lit(0.0)) >= F.coalesce("ib", F.lit(0.0)), F.col("b")).otherwise(F.col("a")).alias("dropped"))


def select_features(df: DataFrame, features: list[str], label: str, least_ic: float = 0.0, least_coverage: float = 0.5, most_corr: float = 0.9) -> DataFrame:
    """``evaluate_features`` with kept: IC and coverage reach their bounds, and no more important kept feature is correlated beyond ``most_corr``.

    The choice walks a list of features (a few dozen rows, collected).
    """
    scored = evaluate_features(df, features, label)
    rows = sorted(scored.collect(), key=lambda r: (-(r["importance"] or 0), r["feature"]))
    corr = {frozenset((r["a"], r["b"])): abs(r["corr"] or 0) for r in correlation_pairs(df, features).collect()}
    kept: list[str] = []
    for r in rows:
        fits = abs(r["ic"] or 0) >= least_ic and r["coverage"] >= least_coverage
        if fits and all(corr[frozenset((r["feature"], k))] < most_corr for k in kept):
            kept.append(r["feature"])
    return scored.withColumn("kept", F.col("feature").isin(kept))


def orthogonal_subset(icir: dict[str, float], corr: dict[frozenset, float], most: int, bound: float = 0.7) -> list[str]:
    """Greedy choice: each time the factor of the largest |icir| * (1 - largest |corr| with the chosen), correlated with none beyond ``bound``."""
    chosen: list[str] = []
    left = sorted(icir)
    while left and len(chosen) < most:
        near = {f: max((abs(corr.get(frozenset((f, c)), 0.0)) for c in chosen), default=0.0) for f in left}
        left = [f for f in left if near[f] <= bound]
        if not left:
            break
        best = max(left, key=lambda f: abs(icir[f]) * (1 - near[f]))
        chosen.append(best)
        left.remove(best)
    return chosen


def _moments(df: DataFrame, factors: list[str]) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with all factors known, and their means, deviations (population) and correlation matrix, from one row of aggregates."""
    known = df.dropna(subset=factors)
    row = known.agg(
        *(F.avg(f).alias(f"m{i}") for i, f in enumerate(factors)), *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(factors)),
        *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(factors) for j, b in enumerate(factors) if i <= j),
    ).first()
    k = len(factors)
    mean, sd = (np.array([row[f"{x}{i}"] or 0.0 for i in range(k)]) for x in "ms")
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    sd = np.where(sd > 1e-12, sd, 1.0)
    return known, mean, sd, cov / np.outer(sd, sd)


def _project(known: DataFrame, factors: list[str], mean: np.ndarray, sd: np.ndarray, loads: np.ndarray, names: list[str]) -> DataFrame:
    """Linear combinations of the standardised factors, as column expressions."""
    z = [(F.col(f) - float(m)) / float(s) for f, m, s in zip(factors, mean, sd)]
    return known.select("code", "dt", *(sum((x * float(v) for x, v in zip(z, column)), F.lit(0.0)).alias(n) for n, column in zip(names, loads.T)))


def orthogonalize_symmetric(df: DataFrame, factors: list[str]) -> DataFrame:
    """code, dt and the factors as uncorrelated columns nearest to the standardised ones: Z R^(-1/2).

    The correlation matrix (factors by factors) is the only thing collected.
    """
    known, mean, sd, r = _moments(df, factors)
    value, vector = np.linalg.eigh(r)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-10))) @ vector.T
    return _project(known, factors, mean, sd, root, factors)


def principal_components(df: DataFrame, factors: list[str], variance: float = 0.95) -> DataFrame:
    """code, dt and pc1... : the components of the standardised factors that explain ``variance``, largest first, the sign such that the largest load is positive."""
    known, mean, sd, r = _moments(df, factors)
    value, vector = np.linalg.eigh(r)
    value, vector = value[::-1], vector[:, ::-1]
    n = int(np.searchsorted(np.cumsum(value) / value.sum(), variance - 1e-12) + 1)
    vector = vector[:, :n] * np.sign(vector[np.abs(vector[:, :n]).argmax(axis=0), np.arange(n)])
    return _project(known, factors, mean, sd, vector, [f"pc{i + 1}" for i in range(n)])


def regress_out(df: DataFrame, x: str, base: list[str]) -> DataFrame:
    """code, dt and x standardised after the base factors are taken out by least squares over all rows (from one row of moments)."""
    known, mean, sd, r = _moments(df, [*base, x])
    beta = np.linalg.lstsq(r[:-1, :-1], r[:-1, -1], rcond=None)[0]
    spread = np.sqrt(max(r[-1, -1] - beta @ r[:-1, -1], 1e-12))
    return _project(known, [*base, x], mean, sd, (np.append(-beta, 1.0) / spread)[:, None], [x])
