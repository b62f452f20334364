"""The alerts of ``operators.alerts`` over a stream, the same for any micro-batching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from alphaloom.operators.alerts import Rule

_OUT = "key string, dt date, kind string, value double"
_STATE = "state int, last date, tell boolean, days array<date>, values array<double>"


def stream_alerts(values: DataFrame, rule: Rule = Rule(), key: str = "factor", late: str = "30 days") -> DataFrame:
    """key, dt, kind, value of a stream with ``key``, dt (date) and value, one row for each key and dt.

    Rows may come in any order within ``late`` of the newest: they wait in the key's state until the watermark has passed
    them and are then taken in order of dt, so how a stream is cut into batches changes nothing but when
    an alert is told. Later rows are left out. The state holds a key's waiting rows and four numbers.
    Rows without a date or value change nothing.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last, tell, days, held = state.get if state.exists else (0, None, False, [], [])
        waiting = list(zip(days, held))
        if not state.hasTimedOut:
            for b in batches:
                waiting += list(zip(b["dt"], b["value"]))
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms").date()
        out, rest = [], []
        for day, x in sorted(waiting):
            if day > mark:
                rest.append((day, x))
                continue
            before, now = now, rule.next_state(now, x)
            if before < rule.after <= now:
                tell = last is None or (day - last).days > rule.quiet_days
                if tell:
                    last = day
                    out.append((group[0], day, "raised", x))
            elif now < rule.after <= before:
                if tell:
                    out.append((group[0], day, "cleared", x))
                tell = False
        state.update((now, last, tell, [d for d, _ in rest], [float(x) for _, x in rest]))
        if rest:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(rest[0][0]).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "dt", "kind", "value"])

    rows = values.select(F.col(key).cast("string").alias("key"), "dt", F.col("value").cast("double").alias("value")).filter("dt is not null and value is not null")
    rows = rows.withColumn("at", F.col("dt").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
