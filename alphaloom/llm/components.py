"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


#: A node with over one in so many edges is a hub; there are fewer hubs than this.
HUBS = 256


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges with m, the least v of their u. Hubs (fewer than ``HUBS`` rows) are broadcast, so no task gathers a hub's edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    hubs = Written(least.filter(F.col("c") * HUBS > total).select("u", "m"), "component-hubs").df
    few = F.broadcast(hubs)
    many = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.select("u", "m"), "u")
    return edges.join(few, "u").unionByName(many)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    moved = _with_least(edges, total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return edges.groupBy("u").agg(F.min("v").alias("v")).unionByName(moved)


def component_roots(edges: DataFrame, label: str = "components") -> DataFrame:
    """Stars (u, v): v is the smallest node of u's component, for each u that is not itself the smallest.

    ``edges`` has two long columns a and b; loops and repeats are allowed, an empty table gives an
    empty one. Each round is written to the shared folder, and the rounds end when nothing changes.
    A node with very many edges is only ever a grouping key of partial aggregates, and a row of a
    broadcast of bounded size.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held = Written(edges, label)
    mark = F.struct(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)))
    before = held.df.agg(mark).first()[0]
    while before[0]:
        large = Written(_large_star(held.df, before[0]).distinct(), label)
        step = Written(_small_star(large.df, large.df.count()).distinct(), label)
        held.drop()
        large.drop()
        held = step
        after = held.df.agg(mark).first()[0]
        if after == before:
            break
        before = after
    return held.df
