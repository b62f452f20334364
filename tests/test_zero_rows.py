"""Zero prices, volumes and weights divide nothing, and Barra risk by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import exposure, performance, timing, weighting

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    close = [0.0, 0.0, 5.0, 4.0, 0.0, 0.0, 3.0, 6.0] * 10
    rows = [(c, DAY + dt.timedelta(i), x if c == "z" else 0.0, 0.0) for c in ("z", "dead") for i, x in enumerate(close)]
    return spark.createDataFrame(rows, "code string, dt date, close double, volume double")


def test_timing_and_performance_pass_over_zero_prices(bars):
    assert timing.drawdown_signal(bars).filter("abs(dd + 0.2) < 1e-9").count() > 0
    assert performance.drawdown_spells(bars).filter("code = 'dead'").count() == 0
    with_signal = bars.withColumn("s", F.lit(timing.LONG))
    assert timing.fuse_by_hits(with_signal, ["s"]).filter("score is null").count() == 0
    assert timing.market_features(bars).filter("code = 'dead' and trend_20 is not null").count() == 0


def test_weights_of_nothing(spark, bars):
    held = spark.createDataFrame([("a", DAY, 1.0, 2.0), ("b", DAY, None, 4.0), ("c", DAY, 3.0, None)], "code string, dt date, f double, g double")
    weights = spark.createDataFrame([(DAY, "f", -0.5), (DAY, "g", 0.0)], "dt date, factor string, weight double")
    got = {r.code: r.score for r in weighting.ic_weighted_score(held, weights, ["f", "g"]).collect()}
    assert got == {"a": -1.0, "b": 4.0, "c": -3.0}  # b knows only a factor of no weight: its plain mean


def test_signed_weights_keep_the_sign(spark):
    ics = spark.createDataFrame([(f, DAY + dt.timedelta(i), x) for f, x in (("up", 0.3), ("down", -0.1)) for i in range(5)], "factor string, dt date, ic double")
    last = {r.factor: r.weight for r in weighting.rolling_ic_weights(ics, method="signed").filter(F.col("dt") == DAY + dt.timedelta(4)).collect()}
    assert last["up"] == pytest.approx(0.75) and last["down"] == pytest.approx(-0.25)
    plain = {r.factor: r.weight for r in weighting.rolling_ic_weights(ics, method="ic").filter(F.col("dt") == DAY + dt.timedelta(4)).collect()}
    assert plain == {"up": 1.0, "down": 0.0}


def test_barra_residuals_and_risk_by_hand(spark):
    r = np.random.default_rng(4)
    x, f, u = r.normal(size=(30, 12)), r.normal(size=12), r.normal(0, 0.1, (30, 12))
    label = 0.5 + x * f + u
    df = spark.createDataFrame([(c, DAY + dt.timedelta(t), float(x[c, t]), float(label[c, t]), 1.0) for c in range(30) for t in range(12)] + [(99, DAY, None, 1.0, 1.0)], "code int, dt date, x double, y double, cap double")
    returns = performance.barra_returns(df, "y", ["x"])
    got = exposure.barra_residuals(df, returns, "y", ["x"])
    assert got.filter("residual is null").count() == 1
    fits = [np.polyfit(x[:, t], label[:, t], 1) for t in range(12)]
    want = np.array([label[:, t] - np.polyval(fits[t], x[:, t]) for t in range(12)]).T
    for row in got.filter("code = 3").collect():
        assert abs(row.residual - want[3, (row.dt - DAY).days]) < 1e-9
    w = 0.5 ** (np.arange(11, -1, -1) / 20)
    specific = exposure.specific_variance(got)
    assert abs(specific.filter("code = 3").first().specific - (w * want[3] ** 2).sum() / w.sum()) < 1e-9
    cov = np.cov(np.array([(b, a) for a, b in fits]).T)
    e = np.array([1.0, x[3, 11]])
    one = spark.createDataFrame([(3, "market", 1.0), (3, "x", float(x[3, 11]))], "code int, factor string, x double")
    total = exposure.decompose_risk(one, exposure.factor_covariance(returns), specific).first()
    assert abs(total.systematic - e @ cov @ e) < 1e-9 and abs(total.total - total.systematic - total.specific) < 1e-12


def test_quotes_of_odd_pages(spark):
    from alphaloom.sources.quotes import parse_quotes, quote_code

    full = "名,1.5,,2.5,3,bad,0,0,100,250.0" + "," * 22
    pages = [(1, f'var hq_str_sh600000="{full}";\nvar hq_str_sz000001="short,1";\njunk'), (2, None), (3, ""), (4, f'x var hq_str_bj1="{full}"; y\nvar hq_str_sz3="{full}')]
    got = parse_quotes(spark.createDataFrame(pages, "page int, text string")).orderBy("page").collect()
    assert [(r.page, r.code, r.name, r.open, r.pre_close, r.price, r.low, r.volume, r.amount) for r in got] == [(p, c, "名", 1.5, None, 2.5, None, 100.0, 250.0) for p, c in ((1, "sh600000"), (4, "bj1"))]
    codes = spark.createDataFrame([("600000.SH",), ("000001.SZ",), ("600001",), ("300001",), (None,)], "ts_code string").select(quote_code()).collect()
    assert [r[0] for r in codes] == ["sh600000", "sz000001", "sh600001", "sz300001", None]
