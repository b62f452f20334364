"""The production portfolio against a plain loop over dates."""

import datetime as dt
import random

import pytest

from alphaloom.operators import tiers

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def ranked(spark):
    r = random.Random(3)
    rows = []
    for t in range(25):
        codes = [c for c in range(40) if r.random() < 0.9]
        r.shuffle(codes)
        order = sorted(codes, key=lambda c: c + r.uniform(-12, 12))
        for k, c in enumerate(order, 1):
            rows.append((c, DAY + dt.timedelta(7 * t), k, c % 6 if c % 6 else None, 0.0 if c == 4 else 10.0 + c, [None, "low", "medium", "high", "extreme", "odd"][c % 6], [None, "normal", "marginal", "insufficient"][c % 4]))
    return rows, spark.createDataFrame(rows, "code int, dt date, rank int, industry int, close double, risk_level string, liquidity_level string").repartition(4)


def loop(rows, bounds, steps, capital, most=0.2, least=0.002):
    out, held = {}, None
    for day in sorted({x[1] for x in rows}):
        own = {x[0]: x for x in rows if x[1] == day}
        if held is None:
            held = {c for c, x in own.items() if x[2] <= bounds.top}
        else:
            held = {c for c, x in own.items() if x[2] <= (bounds.hold if c in held else bounds.buy)}
        w = {c: next((m for last, m in steps if own[c][2] <= last), 1.0) * tiers.RISK_DISCOUNT.get(own[c][5] or "low", 1.0) * tiers.LIQUIDITY_DISCOUNT.get(own[c][6] or "normal", 1.0) for c in held}
        total = sum(w.values())
        w = {c: x / total for c, x in w.items()}
        by = {}
        for c, x in w.items():
            by[own[c][3]] = by.get(own[c][3], 0) + x
        freed, rest = sum(x - most for x in by.values() if x > most), sum(x for x in by.values() if x <= most)
        w = {c: x * most / by[own[c][3]] if by[own[c][3]] > most else x * (1 + (freed / rest if rest else 0)) for c, x in w.items()}
        shares = {c: int(x * capital / own[c][4] // 100) * 100 if own[c][4] > 0 else 0 for c, x in w.items()}
        w = {c: shares[c] * own[c][4] for c in w}
        total = sum(w.values())
        w = {c: x / total for c, x in w.items() if x / total >= least}
        total = sum(w.values())
        out |= {(day, c): (shares[c], round(x / total, 9)) for c, x in w.items() if x > 0}
    return out


@pytest.mark.parametrize("capital", [1e8, 5e4])
def test_portfolio_equals_a_loop(ranked, capital):
    rows, df = ranked
    bounds, steps = tiers.Bounds(15, 10, 22), ((4, 1.5), (9, 1.2), (15, 1.0))
    got = {(r.dt, r.code): (r.shares, round(r.weight, 9)) for r in tiers.tiered_portfolio(df, bounds, steps, capital).collect()}
    assert got == loop(rows, bounds, steps, capital) and len(got) > 100
    assert tiers.tiered_portfolio(df.limit(0)).count() == 0


def test_buffer_holds_and_gaps_sell(spark):
    ranks = {1: [3, 6, 9, 6], 2: [6, 4, 6, 8], 3: [1, None, 7, 5]}
    rows = [(c, DAY + dt.timedelta(i), k) for c, ks in ranks.items() for i, k in enumerate(ks) if k] + [(9, DAY + dt.timedelta(i), 50) for i in range(4)]
    got = {(r.code, (r.dt - DAY).days): r.held for r in tiers.held_names(spark.createDataFrame(rows, "code int, dt date, rank int"), tiers.Bounds(6, 5, 8)).collect()}
    assert [got[1, i] for i in range(4)] == [True, True, False, False] and [got[2, i] for i in range(4)] == [True, True, True, True]
    assert [got[3, i] for i in (0, 2, 3)] == [True, False, True]  # sold on the missing day, 7 is too far to buy
