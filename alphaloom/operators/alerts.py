"""Alerts with hysteresis: raised after a number of low values in a row, cleared after a number of high ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .transitions import states


@dataclass(frozen=True)
class Rule:
    """Values below ``low`` are bad, above ``high`` good, others neither (they end both kinds of streak).

    An alert is raised at the ``after``-th bad value in a row and cleared at the ``until``-th good one. A raise within
    ``quiet_days`` of the last one that was told is not told, nor is its clearing.
    """

    low: float = 0.0
    high: float = 0.02
    after: int = 2
    until: int = 2
    quiet_days: int = 60

    def __post_init__(self) -> None:
        if self.low > self.high or self.after < 1 or self.until < 1:
            raise ValueError("low must not exceed high, and streaks have at least one value")

    def next_state(self, state: int, value: float) -> int:
        """States 0..after-1: well, after so many bad values; then ``until`` states of alert, after so many good ones."""
        bad, good = value < self.low, value > self.high
        if state < self.after:
            return state + 1 if bad else 0  # the last of them is the first state of alert
        return (state + 1) % (self.after + self.until) if good else self.after


def _step(rule: Rule, x: Column) -> Column:
    """The transition map of a value (null for null: nothing changes)."""
    n = rule.after + rule.until
    way = lambda v: F.array(*(F.lit(rule.next_state(s, v)) for s in range(n)))
    return F.when(x < rule.low, way(float("-inf"))).when(x > rule.high, way(float("inf"))).when(x.isNotNull(), way((rule.low + rule.high) / 2))


def alerts(df: DataFrame, rule: Rule = Rule(), key: str = "factor", value: str = "value") -> DataFrame:
    """key, dt, kind (raised or cleared), value: the told alerts of a table with one row for each key and dt."""
    df = states(df.select(key, "dt", F.col(value).alias("value")).filter("dt is not null"), key, _step(rule, F.col("value")), rule.after + rule.until)
    by = W.partitionBy(key).orderBy("dt")
    now, before = F.col("state") >= rule.after, F.coalesce(F.lag("state").over(by), F.lit(0)) >= rule.after
    turns = df.withColumn("kind", F.when(now & ~before, "raised").when(~now & before, "cleared")).filter("kind is not null")
    # turns of a key alternate; which are told depends on the last told raise, so they are walked in order: they are few
    walked = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dt", "kind", "value"))).alias("t"))
    told = f"""aggregate(t, named_struct('last', CAST(NULL AS DATE), 'tell', false, 'out', slice(t, 1, 0)), (acc, x) ->
      CASE WHEN x.kind = 'raised' AND (acc.last IS NULL OR datediff(x.dt, acc.last) > {rule.quiet_days}) THEN named_struct('last', x.dt, 'tell', true, 'out', concat(acc.out, array(x)))
           WHEN x.kind = 'cleared' AND acc.tell THEN named_struct('last', acc.last, 'tell', false, 'out', concat(acc.out, array(x)))
           ELSE named_struct('last', acc.last, 'tell', false, 'out', acc.out) END).out"""
    return walked.select(key, F.inline(F.expr(told)))
