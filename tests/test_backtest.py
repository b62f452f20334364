"""The back-test fold against hand-made days and a plain fold written apart from it."""

import datetime as dt
import math

import numpy as np
import pytest

from alphaloom.operators import backtest as bt

ROW = "code long, dt date, close double, rank int, limit_up boolean, limit_down boolean, suspended boolean, dividend double, bonus double"
CONFIG = "config_id long, n int, every int, most_turnover double"


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def fee(amount, sell):
    return max(0.00025 * amount, 5) + 0.00001 * amount + (0.001 * amount if sell else 0)


def test_hand_made_days(spark):
    rows = [
        (1, day(0), 10.0, 1, False, False, False, None, None), (2, day(0), 20.0, 2, True, False, False, None, None),  # 2 is limit-up: not bought
        (1, day(1), 11.0, 2, False, False, True, None, None), (2, day(1), 20.0, 1, False, False, False, None, None),  # 1 is suspended: not sold
        (1, day(2), 11.0, 2, False, True, False, 0.5, None), (2, day(2), 21.0, 1, False, False, False, None, 0.1),  # 1 is limit-down: not sold, but pays
        (1, day(40), 12.0, 2, False, False, False, 0.5, None), (2, day(40), 21.0, 1, False, False, False, None, None),
    ]
    got = bt.run_backtest(spark.createDataFrame(rows, ROW), spark.createDataFrame([(1, 1, 1, 9.0)], CONFIG), cash=100_000).orderBy("dt").collect()
    each = 10 * 1.0005
    n = int((100_000 - 5_000 - 5) / (each * 1.00026) / 100) * 100  # the buffer stays in cash
    cash = 100_000 - n * each - fee(n * each, False)
    assert got[0].cash == pytest.approx(cash) and got[0].nav == pytest.approx(cash + 10 * n) and (got[0].buys, got[0].sells) == (1, 0)
    value = cash + 11 * n
    m = int((cash - 0.05 * value - 5) / (20 * 1.0005 * 1.00026) / 100) * 100
    assert m <= 0 and got[1].positions == 1 and got[1].nav == pytest.approx(value) and (got[1].buys, got[1].sells) == (0, 0)
    cash += 0.5 * n * 0.8  # held two days: 20 % tax
    value = cash + 11 * n
    each = 21 * 1.0005
    k = int((cash - 0.05 * value - 5) / (each * 1.00026) / 100) * 100
    assert k == 100 and (got[2].buys, got[2].sells) == (1, 0)
    cash -= k * each + fee(k * each, False)
    assert got[2].cash == pytest.approx(cash) and got[2].positions == 2
    cash += 0.5 * n * 0.9  # held over 30 days
    value = cash + 12 * n + 21 * k
    sold = n * 12 * 0.9995
    cash += sold - fee(sold, True)
    more = min(int(value / 21 / 100) * 100 - k, int((cash - 0.05 * value - 5) / (each * 1.00026) / 100) * 100)
    assert (got[3].buys, got[3].sells, got[3].positions) == (1, 1, 1)
    assert got[3].cash == pytest.approx(cash - more * each - fee(more * each, False))


def plain(rows, n, every, most, cash=1e6):
    """One configuration over all rows, by tables of the date."""
    shares, since, price, out = {}, {}, {}, []
    for t, now in enumerate(sorted({r[1] for r in rows})):
        today = {r[0]: r for r in rows if r[1] == now}
        price.update({c: r[2] for c, r in today.items()})
        for c in list(shares):
            if c in today:
                held = (now - since[c]).days
                cash += shares[c] * (today[c][7] or 0) * (0.8 if held <= 30 else 0.9 if held <= 365 else 1)
                shares[c] += math.floor(shares[c] * (today[c][8] or 0))
        if t % every == 0:
            total = cash + sum(shares[c] * price[c] for c in shares)
            before = {c: shares[c] * price[c] / total for c in shares}
            aim = {c: 1 / n for c in today if today[c][3] <= n}
            moved = sum(abs(aim.get(c, 0) - before.get(c, 0)) for c in {*aim, *before}) / 2
            pace = 1 if moved <= most else most / moved
            want = {c: before.get(c, 0) + pace * (aim.get(c, 0) - before.get(c, 0)) for c in {*aim, *before}}
            lots = {c: math.floor(w * total / price[c] / 100 + 1e-9) * 100 if w > 1e-12 else 0 for c, w in want.items()}
            for c in sorted(before):
                if c in today and lots[c] < shares[c] and not today[c][5] and not today[c][6]:
                    got = (shares[c] - lots[c]) * price[c] * 0.9995
                    cash += got - fee(got, True)
                    shares[c] = lots[c]
                    if not shares[c]:
                        del shares[c], since[c]
            for c in sorted(aim, key=lambda c: today[c][3]):
                if lots[c] > shares.get(c, 0) and not today[c][4] and not today[c][6]:
                    k = min(lots[c] - shares.get(c, 0), math.floor(max(cash - 0.05 * total - 5, 0) / (price[c] * 1.0005 * 1.00026) / 100) * 100)
                    if k > 0:
                        cash -= k * price[c] * 1.0005 + fee(k * price[c] * 1.0005, False)
                        shares[c], since[c] = shares.get(c, 0) + k, now
        out.append((now, round(cash + sum(shares[c] * price[c] for c in shares), 4), round(cash, 4), len(shares)))
    return out


def test_fold_equals_the_plain_one(spark):
    rng = np.random.default_rng(8)
    rows = []
    for t in range(40):
        codes = [c for c in range(60) if rng.random() < 0.9]  # names miss dates
        for r, c in enumerate(rng.permutation(codes).tolist()):
            flags = (rng.random(3) < 0.1).tolist()
            rows.append((c, day(9 * t), float(rng.uniform(5, 50)), r + 1, *flags, 0.3 if rng.random() < 0.05 else None, 0.1 if rng.random() < 0.05 else None))
    df = spark.createDataFrame(rows, ROW)
    configs = [(1, 3, 1, 9.0), (2, 8, 1, 0.2), (3, 5, 4, 0.5)]
    got = bt.run_backtest(df, spark.createDataFrame(configs, CONFIG)).orderBy("dt").collect()
    for config, n, every, most in configs:
        mine = [(r.dt, round(r.nav, 4), round(r.cash, 4), r.positions) for r in got if r.config_id == config]
        want = plain(rows, n, every, most)
        assert [x[0] for x in mine] == [x[0] for x in want]
        for a, b in zip(mine, want):
            assert a[3] == b[3] and a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2]), (config, a, b)
    sent = bt.trading_rows(df, spark.createDataFrame([(1, 2, 1, 1.0)], CONFIG))
    chosen = {r[0] for r in rows if r[3] <= 2}
    assert {r.code for r in sent.collect()} - {None} == chosen and sent.filter("code is null").count() == 40
