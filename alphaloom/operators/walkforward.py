"""Walk-forward retraining: all windows' ridge regressions from one pass over the rows.

Sums of products of features and label are taken per date, added up along the dates, and a window's sums
are the difference of two of them; so the rows are read once, however many windows overlap. A window is
solved from a matrix of features by features.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import average_rank, correlation


def windows(dates: DataFrame, train: int, test: int, gap: int, every: int | None = None) -> DataFrame:
    """window_id, train_start, train_end, test_start, test_end over distinct dates (one row a date).

    A model is trained anew each ``every`` dates (default: ``test``) on ``train`` dates, and judged on at most ``test``
    dates after a gap of ``gap``; with ``every`` under ``test`` the test ranges overlap. The last window may have
    fewer test dates.
    """
    every = every or test
    days = dates.select("dt").filter("dt is not null").distinct().withColumn("i", F.row_number().over(W.orderBy("dt")) - 1)
    at = days.agg(F.array_sort(F.collect_list("dt")).alias("all"))  # the calendar
    ids = at.select("all", F.explode(F.expr(f"CASE WHEN size(all) > {train + gap} THEN sequence(0, (size(all) - {train + gap + 1}) div {every}) ELSE array() END")).alias("window_id"))
    k = F.col("window_id") * every
    pick = lambda place: F.element_at("all", (place + 1).cast("int"))
    last = F.least(k + (train + gap + test - 1), F.size("all") - 1)
    return ids.select("window_id", pick(k).alias("train_start"), pick(k + (train - 1)).alias("train_end"), pick(k + (train + gap)).alias("test_start"), pick(last).alias("test_end"))


def _moments(features: list[str], label: str) -> tuple[list[str], list]:
    """Names and aggregates of 1, x, y and their products (upper triangle)."""
    columns = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(label).cast("double")]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return [f"m{i}_{j}" for i, j in pairs], [F.sum(columns[i] * columns[j]) for i, j in pairs]


def fit_windows(df: DataFrame, ranges: DataFrame, features: list[str], label: str, penalty: float = 0.1, least: int = 20) -> DataFrame:
    """``ranges`` with n (training rows), intercept and coef (array): ridge regressions on standardised features, in the features' own units.

    The penalty is on the coefficients of standardised features, per row. Rows with an unknown feature or label do
    not count. Windows of under ``least`` rows, or where a feature does not vary, have no coefficients.
    """
    names, sums = _moments(features, label)
    known = df.dropna(subset=[*features, label]).filter("dt is not null")
    shift = known.agg(*(F.avg(c).alias(c) for c in [*features, label]))  # sums of centred columns lose no digits in differences
    centred = known.crossJoin(F.broadcast(shift.select(*(F.col(c).alias(f"_{c}") for c in [*features, label])))).withColumns({c: F.col(c) - F.col(f"_{c}") for c in [*features, label]})
    per_date = centred.groupBy("dt").agg(*(s.alias(n) for n, s in zip(names, sums)))
    along = W.orderBy("dt").rowsBetween(W.unboundedPreceding, 0)  # one row a date
    prefix = per_date.select("dt", F.array(*(F.sum(n).over(along) for n in names)).alias("p"))
    table = prefix.agg(F.array_sort(F.collect_list(F.struct("dt", "p"))).alias("all"))
    at = lambda bound: F.expr(f"filter(all, x -> x.dt {bound})")
    ends = ranges.crossJoin(F.broadcast(table)).withColumns({"_end": F.element_at(at("<= train_end"), -1)["p"], "_start": F.try_element_at(at("< train_start"), F.lit(-1))["p"]}).drop("all")
    zero = F.array(*(F.lit(0.0) for _ in names))
    gram = ends.withColumn("gram", F.zip_with(F.coalesce("_end", zero), F.coalesce("_start", zero), lambda a, b: a - b)).drop("_end", "_start").crossJoin(F.broadcast(shift))
    k, given = len(features), list(ranges.columns)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(k + 2)
        for b in batches:
            out = b[given].copy()
            fits = []
            for g, middle in zip(b["gram"], b[[*features, label]].to_numpy(float)):
                m = np.zeros((k + 2, k + 2))
                m[upper] = np.asarray(g, float)
                n = m[0, 0]
                if round(n) < least:
                    fits.append((round(n), None, None))
                    continue
                mean = m[0, 1:] / n
                cov = (m[1:, 1:] + np.triu(m[1:, 1:], 1).T) / n - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
                if (sd < 1e-12).any():
                    fits.append((round(n), None, None))
                    continue
                scaled = cov[:k, :k] / np.outer(sd, sd) + penalty * np.eye(k)
                coef = np.linalg.solve(scaled, cov[:k, k] / sd) / sd
                mean = mean + middle
                fits.append((round(n), float(mean[k] - coef @ mean[:k]), coef.tolist()))
            out["n"], out["intercept"], out["coef"] = zip(*fits) if fits else ((), (), ())
            yield out

    schema = ", ".join(f"{c} {t}" for c, t in ranges.dtypes)
    return gram.mapInPandas(solve, f"{schema}, n long, intercept double, coef array<double>")


def predict_windows(df: DataFrame, fits: DataFrame, features: list[str]) -> DataFrame:
    """Rows of ``df`` whose date lies in a test range, with window_id and predicted; once for each window that tests them."""
    calendar = df.select("dt").distinct()
    tested = calendar.join(F.broadcast(fits.filter("coef is not null")), (F.col("dt") >= F.col("test_start")) & (F.col("dt") <= F.col("test_end"))).select("dt", "window_id", "intercept", "coef")
    score = reduce(lambda s, x: s + x, (F.col("coef")[i] * F.col(f) for i, f in enumerate(features)), F.col("intercept"))
    return df.join(F.broadcast(tested), "dt").withColumn("predicted", score).drop("intercept", "coef")  # a row a date and window


def judge_windows(predicted: DataFrame, fits: DataFrame, label: str, least: int = 10) -> DataFrame:
    """Each window's out-of-sample IC, rank IC, their ICIR and error: means over test dates of at least ``least`` known rows.

    window_id, its dates, n (training rows), test_dates, ic, icir, rank_ic, rmse; null where no date counts.
    """
    known = predicted.filter(F.col("predicted").isNotNull() & F.col(label).isNotNull())
    key = ["window_id", "dt"]
    ranked = known.withColumns({"_a": average_rank("predicted", *key), "_b": average_rank(label, *key)})
    daily = ranked.groupBy(*key).agg(correlation("predicted", label, least).alias("ic"), correlation("_a", "_b", least).alias("rank_ic"), F.sum((F.col("predicted") - F.col(label)) ** 2).alias("sse"), F.count(F.lit(1)).alias("rows"))
    sd = F.stddev_samp("ic")
    per = daily.groupBy("window_id").agg(F.count("ic").alias("test_dates"), F.avg("ic").alias("ic"), F.when(sd > 1e-12, F.avg("ic") / sd).alias("icir"), F.avg("rank_ic").alias("rank_ic"), F.sqrt(F.sum("sse") / F.sum("rows")).alias("rmse"))
    return fits.drop("intercept", "coef").join(F.broadcast(per), "window_id", "left").withColumn("test_dates", F.coalesce("test_dates", F.lit(0)))


def backtest_windows(predicted: DataFrame, label: str, n: int = 10, periods: int = 12) -> DataFrame:
    """window_id, dates, total, excess, sharpe, max_drawdown, hit_rate of holding, on each test date, the ``n`` best by ``predicted``, equally.

    The label is the return earned; rows without it or a prediction are not held, ties go to the smaller code. Excess is the total
    less that of all rows of the test dates; the Sharpe ratio takes ``periods`` dates a year.
    """
    known = predicted.filter(F.col("predicted").isNotNull() & F.col(label).isNotNull())
    best = F.row_number().over(W.partitionBy("window_id", "dt").orderBy(F.desc("predicted"), "code")) <= n
    daily = known.withColumn("_best", best).groupBy("window_id", "dt").agg(F.avg(F.when(F.col("_best"), F.col(label))).alias("r"), F.avg(label).alias("m"))
    along = W.partitionBy("window_id").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    grown = lambda c: F.exp(F.sum(F.when(F.col(c) > -1, F.ln(1 + F.col(c))).otherwise(float("-inf"))).over(along))
    daily = daily.withColumns({"nav": grown("r"), "_m": grown("m")})
    daily = daily.withColumn("dd", F.try_divide("nav", F.greatest(F.max("nav").over(along), F.lit(1.0))) - 1)
    sd = F.stddev_samp("r")
    return daily.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("dates"), (F.max_by("nav", "dt") - 1).alias("total"), (F.max_by("nav", "dt") - F.max_by("_m", "dt")).alias("excess"),
        F.when(sd > 1e-12, F.avg("r") / sd * periods**0.5).alias("sharpe"), F.min("dd").alias("max_drawdown"), F.avg((F.col("r") > F.col("m")).cast("double")).alias("hit_rate"),
    )


def retrain(df: DataFrame, features: list[str], label: str, train: int, test: int, gap: int, every: int | None = None, penalty: float = 0.1) -> DataFrame:
    """Fits all windows and judges each on its own test dates. The label of a row must end within ``gap`` dates."""
    fits = fit_windows(df, windows(df, train, test, gap, every), features, label, penalty)
    return judge_windows(predict_windows(df, fits, features), fits, label)
