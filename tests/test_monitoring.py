"""Monitoring, rebalancing by deviation, posterior returns and decay against plain Python."""

from datetime import date, timedelta

import numpy as np
import pytest

from alphaloom.operators import monitoring as mo
from alphaloom.operators import posterior as ps
from alphaloom.operators import risk

START = date(2024, 1, 1)
HELD = "model string, dt date, code long, weight double"


def day(i):
    return START + timedelta(days=i)


def test_exposures_and_crowding(spark):
    held = spark.createDataFrame([("a", day(0), 1, 0.6), ("a", day(0), 2, 0.4), ("a", day(1), 2, 1.0), ("b", day(0), 2, 1.0), ("b", day(1), 3, 1.0)], HELD)
    members = spark.createDataFrame([(1, 7), (2, None)], "code long, industry int")
    factors = spark.createDataFrame([(day(0), 1, "size", 2.0), (day(0), 2, "size", None), (day(1), 9, "size", 5.0)], "dt date, code long, factor string, x double")
    got = {(r.model, r.dt, r.kind, r.name): r.exposure for r in mo.held_exposures(held, members, factors).collect()}
    assert got == {("a", day(0), "industry", "7"): 0.6, ("a", day(0), "industry", "other"): 0.4, ("a", day(1), "industry", "other"): 1.0, ("b", day(0), "industry", "other"): 1.0, ("b", day(1), "industry", "other"): 1.0, ("a", day(0), "style", "size"): 1.2}
    rows = {(r.model, r.dt): (r.held, r.shared, r.crowding, r.turnover) for r in mo.crowding(held).collect()}
    assert rows[("a", day(0))] == (2, 1, 0.5, None) and rows[("b", day(0))] == (1, 1, 1.0, None)
    assert rows[("a", day(1))][:3] == (1, 0, 0.0) and rows[("a", day(1))][3] == pytest.approx(0.6) and rows[("b", day(1))][3] == 1.0
    assert mo.crowding(held.limit(0)).count() == mo.held_exposures(held.limit(0), members, factors).count() == 0


def test_risk_report_and_alerts(spark):
    rng = np.random.default_rng(5)
    r = {(i, c): float(x) for i in range(40) for c, x in enumerate(rng.normal(0, 0.03, 3)) if rng.random() > 0.1}
    r[(30, 0)] = -1.0  # a total loss
    r[(31, 1)] = None
    returns = spark.createDataFrame([(day(i), c, x) for (i, c), x in r.items()], "dt date, code long, ret double")
    held = {("m", 39): {0: 0.5, 1: 0.5}, ("m", 29): {1: 0.3, 2: 0.7}, ("n", 39): {0: 1.0}, ("n", 3): {2: 1.0}, ("n", 39.5): {77: 1.0}}
    held = {(m, int(i + 0.5)): w for (m, i), w in held.items()}
    frame = spark.createDataFrame([(m, day(i), c, w) for (m, i), ws in held.items() for c, w in ws.items()], HELD)
    report = mo.risk_report(frame, returns, 15, 8)
    got = {(x.model, x.dt): x for x in report.collect()}
    dates = sorted({i for (i, _), x in r.items() if x is not None} | {i for _, i in held})
    for (m, i), ws in held.items():
        window = [d for d in dates if d <= i][-15:]
        series = np.array([sum(w * (r.get((d, c)) or 0.0) for c, w in ws.items()) for d in window if any(r.get((d, c)) is not None for c in ws)])
        x = got[(m, day(i))]
        assert x.days == len(series) and x.max_weight == max(ws.values())
        if len(series) < 8:
            assert x["var"] is x.cvar is x.drawdown is None
            continue
        q, nav = np.percentile(series, 5), np.cumprod(1 + series)
        assert np.allclose([x["var"], x.cvar, x.drawdown], [-q, -series[series <= q].mean(), (nav / np.maximum.accumulate(nav) - 1).min()])
    alerts = {(a.model, a.dt, a.alert) for a in mo.risk_alerts(report, mo.Limits(0.6, 0.02, 0.03, 0.5)).collect()}
    want = set()
    for (m, dt), x in got.items():
        want |= {(m, dt, n) for n, broken in (("concentration", x.max_weight > 0.6), ("var_breach", (x["var"] or 0) > 0.02), ("cvar_breach", (x.cvar or 0) > 0.03), ("drawdown_breach", (x.drawdown or 0) < -0.5)) if broken}
    assert alerts == want and {a for _, _, a in want} == {"concentration", "var_breach", "cvar_breach", "drawdown_breach"}


@pytest.mark.parametrize(("threshold", "least", "block"), [(0.15, 3, 2), (0.4, 1, 50), (9.0, 2, 4)])
def test_rebalance_by_deviation_equals_a_loop(spark, threshold, least, block):
    rng = np.random.default_rng(8)
    level, targets = rng.random(6), []
    for i in range(45):
        level = np.abs(level + rng.normal(0, 0.05, 6))
        chosen = [8, 9] if i in (20, 21) else [c for c in range(6) if rng.random() > 0.2]  # two dates share no code with others
        w = level[chosen] if chosen[0] < 8 else np.ones(2)
        targets.append(dict(zip(chosen, (w / w.sum()).tolist())))
    frame = spark.createDataFrame([(day(i), c, w) for i, t in enumerate(targets) for c, w in t.items()], "dt date, code long, weight double")
    got = {r.dt: (r.since, r.rebalance, r.deviation) for r in mo.rebalance_by_deviation(frame, threshold, least, block).collect()}
    held = 0
    for i, t in enumerate(targets):
        common = targets[held].keys() & t.keys()
        far = np.sqrt(sum((targets[held][c] - t[c]) ** 2 for c in common)) if common else None
        now = i == 0 or (i - held >= least and (far is None or far > threshold))
        since, flag, deviation = got[day(i)]
        assert (since, flag, deviation is None) == (day(held), now, far is None) and (far is None or abs(deviation - far) < 1e-12)
        held = i if now else held
    assert mo.rebalance_by_deviation(frame.limit(0)).count() == 0


def test_posterior_equals_the_precision_form(spark):
    rng = np.random.default_rng(4)
    cov, market = np.cov(rng.normal(size=(60, 4)).T), np.array([0.4, 0.3, 0.2, 0.1])
    views = np.array([0.05, np.nan, -0.02, np.nan])
    prior, post = ps.posterior_returns(cov, market, views, 0.05)
    p, omega = np.eye(4)[[0, 2]], np.diag(0.05 * np.diag(cov)[[0, 2]])
    inverse = np.linalg.inv(0.05 * cov)
    want = np.linalg.solve(inverse + p.T @ np.linalg.inv(omega) @ p, inverse @ prior + p.T @ np.linalg.inv(omega) @ views[[0, 2]])
    assert np.allclose(prior, 2.5 * cov @ market) and np.allclose(post, want)
    assert np.allclose(ps.posterior_returns(cov, market, np.full(4, np.nan), 0.05)[1], prior)
    rows = [(int(i), int(j), day(0), float(cov[i, j])) for i in range(4) for j in range(i, 4)] + [(0, 0, day(1), 1.0)]
    keys = spark.createDataFrame([(day(0), i, float(m), None if np.isnan(v) else float(v)) for i, (m, v) in enumerate(zip(market, views))], "dt date, key long, market double, view double")
    out = ps.black_litterman(spark.createDataFrame(rows, "a long, b long, dt date, cov double"), keys, [0.05, 0.1], cap=0.6).collect()
    assert {r.dt for r in out} == {day(0)} and len(out) == 8
    for tau in (0.05, 0.1):
        part = sorted((r for r in out if r.tau == tau), key=lambda r: r.key)
        assert abs(sum(r.weight for r in part) - 1) < 1e-6 and max(r.weight for r in part) <= 0.6 + 1e-9
        assert np.allclose([r.weight for r in part], risk.mean_variance(np.array([r.posterior for r in part]), cov, 1.0, 0.6), atol=1e-6)
        assert np.allclose([r.posterior for r in part], ps.posterior_returns(cov, market, views, tau)[1])


def test_decay_with_offset_finds_a_planted_decay(spark):
    rows = [("fast", day(i), 0.2 * np.exp(-0.1 * i) + 0.01) for i in range(60)] + [("flat", day(i), 0.03 + 1e-4 * i) for i in range(60)] + [("short", day(i), 0.1) for i in range(5)]
    rows += [("fast", day(99), None)]
    got = {r.factor: r for r in ps.decay_with_offset(spark.createDataFrame([(k, d, None if x is None else float(x)) for k, d, x in rows], "factor string, dt date, ic double"), "factor").collect()}
    fast = got["fast"]
    assert fast.n == 60 and fast.decaying and abs(fast.rate - 0.1) < 5e-4 and abs(fast.initial - 0.2) < 1e-3 and abs(fast.steady - 0.01) < 1e-3 and abs(fast.half_life - np.log(2) / 0.1) < 0.05
    assert not got["flat"].decaying and got["short"].n == 5 and got["short"].rate is None and got["short"].decaying is None
