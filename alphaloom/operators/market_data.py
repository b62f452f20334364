"""Cleaning, quality checks, calendars and universes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import pct_change, series


#: Accuracy of sketched quantiles.
RANKS = 100_000


def parse_date(x: str | Column) -> Column:
    """Dates written as YYYYMMDD, YYYY-MM-DD or YYYY/MM/DD; null for anything else."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(p)).cast("date") for p in ("yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd")))


#: Daily limits in percent by the first digits of a code, the rest's limit, and the slack (fixed values).
WIDE_BOARDS, WIDE_LIMIT, LIMIT, SLACK = ("688", "30"), 20.0, 10.0, 0.5


def clean(df: DataFrame, order: str = "seq", filled: tuple[str, ...] = ("amount",)) -> DataFrame:
    """Daily bars (code, dt, ts_code, open, high, low, close, volume, ``order`` of delivery) cleaned and flagged.

    Rows without code, dt, open, high, low, close or volume go, and rows with a negative price or
    volume; of equal keys the one delivered last stays. ``filled`` columns take the code's last known
    value. Flags: bars that contradict themselves, moves beyond the board's limit, suspended days.
    """
    numbers = ["open", "high", "low", "close", "volume"]
    df = df.dropna(subset=["code", "dt", *numbers]).filter(" and ".join(f"{c} >= 0" for c in numbers))
    last = F.row_number().over(W.partitionBy("code", "dt").orderBy(F.col(order).desc()))
    df = df.withColumn("_rn", last).filter("_rn = 1").drop("_rn")
    w = series().rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({"pct": pct_change("close"), "pre_close": F.lag("close").over(series())} | {c: F.last(c, ignorenulls=True).over(w) for c in filled})
    limit = F.when(reduce(lambda a, p: a | F.col("ts_code").startswith(p), WIDE_BOARDS, F.lit(False)), WIDE_LIMIT).otherwise(LIMIT)
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    return df.withColumns({
        "ohlc_flag": bad, "limit_flag": F.coalesce(F.abs("pct") * 100 > limit + SLACK, F.lit(False)),
        "suspended": F.coalesce((F.col("volume") == 0) & (F.col("close") == F.col("pre_close")), F.lit(False)),
    })


def clean_codes(df: DataFrame) -> DataFrame:
    """Upper-cased, trimmed six-digit codes of the two main exchanges, other boards and malformed codes dropped."""
    df = df.withColumn("ts_code", F.upper(F.trim("ts_code")))
    return df.filter(F.col("ts_code").rlike(r"^\d{6}\.(SH|SZ)$") & ~F.col("ts_code").rlike("^[84]"))


def quality_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing share, share beyond 5 MADs and duplicate keys: one row a column.

    Medians are values whose rank is within one in ``RANKS`` of the middle, from mergeable sketches, so
    no task gathers a column.
    """
    tall = df.select("code", "dt", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")).select("code", "dt", "v.*")
    centre = tall.groupBy("name").agg(F.percentile_approx("x", 0.5, RANKS).alias("med"))
    off = tall.join(F.broadcast(centre), "name").withColumn("d", F.abs(F.col("x") - F.col("med")))  # a row a column
    spread = off.groupBy("name").agg(F.percentile_approx("d", 0.5, RANKS).alias("mad"))
    keys = df.groupBy("code", "dt").agg(F.count(F.lit(1)).alias("c")).agg((F.sum("c") - F.count(F.lit(1))).alias("duplicates"))
    out = off.join(F.broadcast(spread), "name").groupBy("name").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("x").isNull().cast("double")).alias("missing"),
        F.avg(F.coalesce((F.col("mad") > 0) & (F.col("d") > 5 * F.col("mad")), F.lit(False)).cast("double")).alias("outliers"),
    )
    return out.join(F.broadcast(keys))  # one row


def missing_days(calendar: DataFrame, df: DataFrame) -> DataFrame:
    """Calendar days without any row."""
    return calendar.select("dt").distinct().join(df.select("dt").distinct(), "dt", "left_anti")


def next_open(calendar: DataFrame, n: int = 1) -> DataFrame:
    """Each open day with the n-th open day after and before it (a calendar has one row a day)."""
    w = W.orderBy("dt")
    return calendar.select("dt").distinct().withColumns({"next_day": F.lead("dt", n).over(w), "prev_day": F.lag("dt", n).over(w)})


def latest_rows(df: DataFrame, day: str) -> DataFrame:
    """The rows of ``day``, or of the latest date before it."""
    known = df.filter(F.col("dt") <= F.lit(day).cast("date"))
    last = known.agg(F.max("dt").alias("dt"))
    return known.join(F.broadcast(last), "dt")  # one row


def recent(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each code."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy("code").orderBy(F.col("dt").desc()))).filter(F.col("_rn") <= n).drop("_rn")


def universe(df: DataFrame, securities: DataFrame, day: str, n: int = 6, least_rows: int = 12, least_price: float = 3.0, liquidity: float = 0.8, events: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """Eligible codes at ``day``: long enough listed, priced, liquid, not special-treated, without recent risk events, not blacklisted."""
    known = df.filter(F.col("dt") <= F.lit(day).cast("date"))
    listed = known.groupBy("code").agg(F.count(F.lit(1)).alias("rows"), F.max_by("close", "dt").alias("close"))
    liquid = recent(known, n).groupBy("code").agg(F.avg("amount").alias("amount"))
    pool = listed.join(liquid, "code").join(securities.filter("not is_st"), "code", "left_semi").filter((F.col("rows") >= least_rows) & (F.col("close") >= least_price))
    floor = pool.agg(F.percentile("amount", 1 - liquidity).alias("floor"))
    pool = pool.join(F.broadcast(floor)).filter("amount >= floor").drop("floor")  # one row
    for other in (events, blacklist):
        if other is not None:
            pool = pool.join(other.select("code"), "code", "left_anti")
    return pool


def one_price_bars(df: DataFrame) -> DataFrame:
    """Codes and dates whose bar has one price throughout."""
    return df.filter("open = high and high = low and low = close and close > 0").select("code", "dt")


def quality_checks(df: DataFrame, statements: DataFrame, move: float = 0.2, most: int = 50, gap: float = 0.01) -> DataFrame:
    """kind, code, dt, value: the ``most`` largest moves beyond ``move``, statements that do not balance, bars without volume."""
    moves = df.withColumn("value", F.abs(pct_change("close"))).filter(F.col("value") > move).orderBy(F.col("value").desc(), "code", "dt").limit(most)  # a report of the largest
    off = statements.filter("assets <> 0").withColumn("value", F.abs(F.col("assets") - F.col("owed") - F.col("equity")) / F.abs("assets")).filter(F.col("value") > gap).withColumn("dt", F.col("end_date"))
    still = df.filter("volume = 0 and close > 0").withColumn("value", F.col("volume"))
    parts = [x.select(F.lit(name).alias("kind"), "code", "dt", F.col("value").cast("double")) for name, x in (("large_move", moves), ("unbalanced", off), ("no_volume", still))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _hash_before(log: DataFrame, size: int = 100_000) -> DataFrame:
    """``_before``: the hash of the entry before by seq, empty for the first.

    Entries are cut into ranges of seq; each range takes its predecessor's last hash from one row
    a range, so no task sees the whole log.
    """
    log = log.withColumn("_r", F.floor(F.col("seq") / size))
    ends = log.groupBy("_r").agg(F.max_by("hash", "seq").alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(W.orderBy("_r"))).select("_r", "_carry")  # one row a range
    return log.join(ends, "_r").withColumn("_before", F.coalesce(F.lag("hash").over(W.partitionBy("_r").orderBy("seq")), F.col("_carry"), F.lit(""))).drop("_r", "_carry")


def chain(log: DataFrame) -> DataFrame:
    """A log (seq, hash) with the hash of the entry before as ``previous``."""
    return _hash_before(log).withColumnRenamed("_before", "previous")


def verify_chain(log: DataFrame) -> DataFrame:
    """seq, valid: whether ``hash`` is the hash of the entry as it stands, and ``previous`` that of the entry before."""
    own = F.col("hash") == F.sha2("entry", 256)
    return _hash_before(log).select("seq", (own & (F.col("previous") == F.col("_before"))).alias("valid"))
