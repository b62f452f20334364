"""Column builders: guarded arithmetic, ranks and rolling aggregates with pandas-like minimum counts."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-8


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(n: str | Column, d: str | Column, eps: float = EPS) -> Column:
    """n / d, null where |d| is below eps."""
    return F.when(F.abs(col(d)) >= eps, col(n) / col(d))


def clip(x: str | Column, low, high) -> Column:
    """x within [low, high]; null stays null (a null bound does not bind)."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high)))


def sanitize(x: str | Column) -> Column:
    """NaN and infinities become null."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def series(code: str = "code", dt: str = "dt") -> WindowSpec:
    return W.partitionBy(code).orderBy(dt)


def date(*by: str) -> WindowSpec:
    return W.partitionBy(*(by or ("dt",)))


def rolling(agg: Callable[[Column], Column], x: str | Column, n: int, least: int | None = None, over: WindowSpec | None = None) -> Column:
    """agg of the last n rows where at least ``least`` (default n) are not null."""
    w = (over or series()).rowsBetween(-(n - 1), 0)
    x = col(x)
    return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))


def pct_change(x: str | Column, n: int = 1, over: WindowSpec | None = None) -> Column:
    before = F.lag(col(x), n).over(over or series())
    return F.when(before != 0, col(x) / before - 1)


def average_rank(x: str | Column, *by: str) -> Column:
    """1-based rank among the non-null values of a group, ties sharing their mean; null for null."""
    x, by = col(x), by or ("dt",)
    group = W.partitionBy(*by, x.isNull())
    first = F.rank().over(group.orderBy(x))
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, x))
    return F.when(x.isNotNull(), first + (ties - 1) / 2)


def correlation(x: str | Column, y: str | Column, least: int = 2) -> Column:
    """Pearson over rows where both are known; null below ``least`` rows or for a constant side."""
    both = col(x).isNotNull() & col(y).isNotNull()
    x, y = F.when(both, col(x)), F.when(both, col(y))
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when((F.count(x) >= least) & (spread > 1e-15), F.covar_samp(x, y) / spread)


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Inverse normal distribution function of probabilities within (0, 1)."""
    inverse = NormalDist().inv_cdf
    return p.map(lambda v: None if pd.isna(v) or not 0 < v < 1 else inverse(v))
