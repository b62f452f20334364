"""Registered queries: versioned stores, table digests, and what changed between versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.sources.store import scratch
from alphaloom.sources.tables import PANEL, panel, table
from alphaloom.sources.versions import VersionedStore, digests

from .registry import query


def yearly(spark, d) -> VersionedStore:
    """The panel in four batches (versions 1 to 4), the second of them sent twice; version 5 loses dear rows of 1996."""
    store, p = VersionedStore(spark, scratch(spark, "versions"), ["code", "dt"]), panel(spark, d)
    for batch, years in (("a", "year(dt) < 1994"), ("b", "year(dt) in (1994, 1995)"), ("b", "year(dt) in (1994, 1995)"), ("c", "year(dt) in (1996, 1997)"), ("d", "year(dt) > 1997")):
        store.append(p.filter(years), batch)
    store.delete(F.expr("year(dt) = 1996 and month(dt) < 4 and code % 2 = 0"))
    return store


@query("code dt", "close", f"WITH {PANEL} --- SELECT code, dt, close FROM panel WHERE NOT (year(dt) = 1996 AND month(dt) < 4 AND code % 2 = 0)", 9)
def versions_head(spark, d):
    return yearly(spark, d).read(columns=["code", "dt", "close"])


@query("version code dt", "close", f"WITH {PANEL} --- SELECT v AS version, code, dt, close FROM panel, (VALUES (1, 1993), (2, 1995), (3, 1997), (4, 9999)) AS t(v, y) WHERE year(dt) <= y AND dt BETWEEN DATE '1995-02-01' AND DATE '1996-02-20'", 9)
def versions_time_travel(spark, d):
    store, out = yearly(spark, d), None
    for v in (1, 2, 3, 4):
        one = store.read(v, "1995-02-01", "1996-02-20", columns=["code", "dt", "close"]).withColumn("version", F.lit(v))
        out = one if out is None else out.unionByName(one)
    return out


@query("code dt side", "", f"WITH {PANEL} --- SELECT code, dt, 'removed' AS side FROM panel WHERE year(dt) = 1996 AND month(dt) < 4 AND code % 2 = 0")
def versions_changes(spark, d):
    return yearly(spark, d).changes(4, 5).select("code", "dt", "side")


_HASH = "CAST('0x' || substr(md5(concat_ws(chr(1), o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'))), 1, 15) AS BIGINT)"


@query("part n low high mix", "", f"""WITH h AS (SELECT strftime(o_orderdate, '%Y-%m') AS part, {_HASH} AS h FROM orders) ---
  SELECT part, count(*) AS n, CAST(sum(h % 1073741824) AS BIGINT) AS low, CAST(sum(h // 1073741824) AS BIGINT) AS high, bit_xor(h) AS mix FROM h GROUP BY 1""")
def table_digests(spark, d):
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return digests(orders, ["o_orderkey", "o_custkey", "o_orderstatus", "day"], F.date_format("day", "yyyy-MM"))
