"""Rectangles and two-axis reads against every pair of dates."""

import datetime as dt
import random

import pytest

from alphaloom.operators import bitemporal

DAY = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(n)


@pytest.fixture(scope="module")
def stated():
    r = random.Random(4)
    rows = [(r.randrange(3), a := r.randrange(12), r.choice([None, a + r.randrange(-1, 6), 12]), r.randrange(12), r.randrange(3), n) for n in range(60)]
    return rows + [(None, 1, 5, 1, 0, 90), (1, None, 5, 1, 0, 91), (1, 2, 5, None, 0, 92), rows[0], (7, 3, 3, 1, 0, 93), (8, 0, None, 5, None, 94), (8, 0, None, 5, 0, 95)]


@pytest.fixture(scope="module")
def reports(spark, stated):
    return spark.createDataFrame([(c, day(a), day(z), day(k), v, n) for c, a, z, k, v, n in stated], "code int, start date, end date, known date, revision int, value int").repartition(4)


def word(stated, code, valid, known):
    """Values that may be the latest word (several if reports tie in everything that decides)."""
    told = [x for x in stated if x[0] == code and None not in (x[1], x[3]) and x[1] <= valid and (x[2] is None or valid < x[2]) and x[3] <= known]
    best = max(((x[3], -1 if x[4] is None else x[4]) for x in told), default=None)
    return {x[5] for x in told if (x[3], -1 if x[4] is None else x[4]) == best} or {None}


def test_rectangles_tell_every_pair_of_dates(reports, stated):
    got = bitemporal.rectangles(reports).collect()
    for code in (0, 1, 2, 7, 8):
        for valid in range(14):
            for known in range(14):
                hit = [r.value for r in got if r.code == code and r.valid_from <= day(valid) and (r.valid_to is None or day(valid) < r.valid_to) and r.known_from <= day(known) and (r.known_to is None or day(known) < r.known_to)]
                assert len(hit) <= 1 and set(hit or [None]) <= word(stated, code, valid, known)
    assert all(r.value < 90 or r.value == 95 for r in got)


def test_reads_on_both_axes(spark, reports, stated):
    asked = [(c, v, k, "x") for c in (0, 1, 2, 7, 8, 99, None) for v in range(-1, 14) for k in range(-1, 14)] + [(0, 3, None, "x"), (0, None, 3, "x"), (0, 3, 3, "x")]
    df = spark.createDataFrame([(c, day(v), day(k), x) for c, v, k, x in asked], "code int, valid_at date, known_at date, report_name string")
    got = bitemporal.as_of_both(reports, df).collect()
    assert len(got) == len(asked)
    for r in got:
        value = r.report.value if r.report else None
        if r.code is None or r.valid_at is None or r.known_at is None:
            assert value is None
        else:
            assert value in word(stated, r.code, (r.valid_at - DAY).days, (r.known_at - DAY).days)
    assert bitemporal.as_of_both(reports.limit(0), df).filter("report is not null").count() == 0 and bitemporal.rectangles(reports.limit(0)).count() == 0
