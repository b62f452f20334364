"""One-pass analysis against the separate operators; alerts against a loop, in batches and streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import analysis, research
from alphaloom.operators.alerts import Rule, alerts
from alphaloom.plans.research import labelled
from alphaloom.streaming.alerts import stream_alerts

DAY = dt.date(2020, 1, 1)


def test_one_pass_equals_the_separate_operators(spark, sf):
    df = labelled(spark, sf)
    got = analysis.analyse(df, "f", (1, 3)).cache()
    for h in (1, 3):
        ics = {r.dt: (r.n, round(r.ic or 9, 9), round(r.rank_ic or 9, 9)) for r in research.ic_series(df, "f", f"fwd_{h}").collect()}
        assert ics and ics == {r.dt: (r.n, round(r.ic or 9, 9), round(r.rank_ic or 9, 9)) for r in got.filter(f"horizon = {h} and grp is null and n >= 10").collect()}
        groups = {(r.dt, r.grp): (r.n, round(r.ret, 9)) for r in research.group_returns(df, "f", f"fwd_{h}").collect()}
        assert groups == {(r.dt, r.grp): (r.n, round(r.ret, 9)) for r in got.filter(f"horizon = {h} and grp is not null").collect()}
    stats = research.ic_statistics(research.ic_series(df, "f", "fwd_1")).first()
    row = analysis.report(got).filter("horizon = 1").first()
    assert row.dates == stats.n and abs(row.mean_ic - stats.mean_ic) < 1e-12 and abs(row.nw_t - stats.nw_t) < 1e-9
    assert analysis.report(analysis.analyse(df.limit(0), "f")).count() == 0


def test_the_panel_is_dealt_by_date_once(spark, sf):
    bars = spark.createDataFrame([], "code int, dt date, close double, f double")
    plan = analysis.analyse(bars, "f")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 3  # by code for the returns, by date, and of sums


def test_quantiles_with_ties_nulls_and_zero_prices(spark):
    rows = [(c, DAY + dt.timedelta(31 * m), 0.0 if c == 3 else 10.0 + c * m, float(c % 2) if c != 5 else None) for c in range(12) for m in range(3)]
    got = analysis.analyse(spark.createDataFrame(rows, "code int, dt date, close double, f double"), "f", (1,), least=3).filter(F.col("dt") == DAY).collect()
    assert {r.grp: r.n for r in got} == {None: 10, 1: 6, 3: 4} or {r.grp for r in got} <= {None, 1, 2, 3, 4, 5}
    assert sum(r.n for r in got if r.grp) == next(r.n for r in got if r.grp is None) == 10


def loop(rule, rows):
    out, state, last, tell = [], 0, None, False
    for day, x in sorted(r for r in rows if None not in r):
        before, state = state, rule.next_state(state, x)
        if before < rule.after <= state:
            tell = last is None or (day - last).days > rule.quiet_days
            if tell:
                last = day
                out.append((day, "raised"))
        elif state < rule.after <= before:
            if tell:
                out.append((day, "cleared"))
            tell = False
    return out


def values(seed):
    r = random.Random(seed)
    return {k: [(DAY + dt.timedelta(i), r.choice([-0.1, -0.05, 0.01, 0.05, 0.1]) if r.random() < 0.95 else None) for i in range(200) if r.random() < 0.8] for k in ("a", "b", "c")}


@pytest.mark.parametrize("rule", [Rule(0.0, 0.02, 2, 2, 20), Rule(0.0, 0.02, 1, 1, 0), Rule(-0.06, 0.0, 3, 1, 45)])
def test_alerts_equal_a_loop(spark, rule):
    held = values(1)
    df = spark.createDataFrame([(k, d, x) for k, rows in held.items() for d, x in rows] + [("a", None, 1.0)], "factor string, dt date, value double").repartition(4)
    got = alerts(df, rule).orderBy("factor", "dt").collect()
    assert [(r.factor, r.dt, r.kind) for r in got] == [(k, *x) for k in held for x in loop(rule, held[k])] and got
    assert alerts(df.limit(0), rule).count() == 0
    with pytest.raises(ValueError):
        Rule(0.5, 0.1)


@pytest.mark.parametrize("files, seed", [(1, 0), (5, 1), (9, 2)])
def test_streams_tell_the_same_however_they_are_cut(spark, tmp_path, files, seed):
    """Rows come up to ten days out of order, in batches of any size; a last row moves the watermark past all."""
    rule, held = Rule(0.0, 0.02, 2, 2, 20), values(1)
    r = random.Random(seed)
    rows = sorted(((k, d, x) for k, own in held.items() for d, x in own), key=lambda row: row[1].toordinal() + r.uniform(0, 10))
    cuts = sorted(r.randrange(len(rows)) for _ in range(files - 1))
    parts = [rows[a:z] for a, z in zip([0, *cuts], [*cuts, len(rows)])] + [[("z", DAY + dt.timedelta(400), 1.0)], [("z", DAY + dt.timedelta(401), 1.0)]]
    schema = "factor string, dt date, value double"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"alerts_{files}_{seed}"
    q = stream_alerts(stream, rule).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((x.key, x.dt, x.kind) for x in spark.sql(f"SELECT * FROM {name}").collect() if x.key != "z")
    assert got == [(k, *x) for k in held for x in loop(rule, held[k])]
