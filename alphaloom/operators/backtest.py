"""The back-test fold: dates in order, one configuration beside another, over the rows a configuration can ever trade."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rates of commission, transfer fee, stamp duty and slippage, and the least commission (fixed values).
COMMISSION, TRANSFER, STAMP, SLIP, LEAST_FEE = 0.00025, 0.00001, 0.001, 0.0005, 5.0
RESULT = "config_id long, dt date, nav double, cash double, positions long, turnover double, cost double, buys long, sells long"
OPTIONAL = {"limit_up": "boolean", "limit_down": "boolean", "suspended": "boolean", "dividend": "double", "bonus": "double"}


def trading_rows(df: DataFrame, configs: DataFrame) -> DataFrame:
    """Per configuration (config_id, n, ...): all rows of the codes that are ever within its first n, and one row without a code for each date.

    A name that is suspended or at its limit stays held after it has left the first n, so the later rows of
    a selected code count. Their number follows the names chosen, not the securities there are.
    """
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in df.columns}
    df = df.withColumns(missing).select("code", "dt", "close", "rank", *OPTIONAL)
    few = F.broadcast(configs)  # a row a configuration
    most = configs.agg(F.max("n").alias("_most"))
    chosen = df.join(F.broadcast(most), F.col("rank") <= F.col("_most")).groupBy("code").agg(F.min("rank").alias("_best"))
    held = df.join(chosen, "code").join(few, F.col("_best") <= F.col("n")).drop("_best")
    days = df.select("dt").distinct().crossJoin(few)
    empty = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns if c != "dt"]
    return held.unionByName(days.select("dt", *empty, *configs.columns))


def trading_fee(amount: float, sell: bool) -> float:
    return max(amount * COMMISSION, LEAST_FEE) + amount * TRANSFER + (amount * STAMP if sell else 0.0)


def dividend_tax(days: int) -> float:
    """Share of a cash dividend that is taxed away, by the days a name was held."""
    return 0.2 if days <= 30 else 0.1 if days <= 365 else 0.0


class Book:
    """Cash and lots of one configuration."""

    def __init__(self, cash: float, lot: int):
        self.cash, self.lot, self.cost = cash, lot, 0.0
        self.shares: dict = {}
        self.since: dict = {}  # day of the last purchase
        self.price: dict = {}

    def value(self) -> float:
        return self.cash + sum(n * self.price[c] for c, n in self.shares.items())

    def pay_out(self, code, day, dividend: float, bonus: float) -> None:
        n = self.shares[code]
        self.cash += n * dividend * (1 - dividend_tax((day - self.since[code]).days))
        self.shares[code] += int(n * bonus)

    def sell(self, code, n: int) -> None:
        amount = n * self.price[code] * (1 - SLIP)
        fee = trading_fee(amount, True)
        self.cash += amount - fee
        self.cost += fee + n * self.price[code] * SLIP
        self.shares[code] -= n
        if not self.shares[code]:
            del self.shares[code], self.since[code]

    def buy(self, code, n: int, day, spare: float) -> bool:
        """As many of ``n`` shares in lots as cash beyond ``spare`` takes."""
        each = self.price[code] * (1 + SLIP)
        n = min(n, int(max(self.cash - spare - LEAST_FEE, 0.0) / (each * (1 + COMMISSION + TRANSFER)) / self.lot) * self.lot)
        if n <= 0:
            return False
        fee = trading_fee(n * each, False)
        self.cash -= n * each + fee
        self.cost += fee + n * self.price[code] * SLIP
        self.shares[code] = self.shares.get(code, 0) + n
        self.since[code] = day
        return True


def run_backtest(df: DataFrame, configs: DataFrame, cash: float = 1e6, lot: int = 100, buffer: float = 0.05) -> DataFrame:
    """config_id, dt, nav, cash, positions, turnover, cost, buys, sells of each configuration (config_id, n, every, most_turnover).

    ``df``: code, dt, close, rank, and where known limit_up, limit_down, suspended, dividend, bonus. On
    every ``every``-th date the first n names get equal weights; beyond ``most_turnover`` the change is
    scaled down. Sales come first: none of suspended or limit-down names, none of shares bought that day.
    Then purchases by rank, in lots, none of suspended or limit-up names, keeping ``buffer`` of the value
    in cash. Prices are the date's closes with slippage, fees have a least commission, dividends are
    taxed by days held. Dates are a chain, so a configuration is one task; its rows are ``trading_rows``.
    """

    def fold(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n, every, most = int(part["n"].iloc[0]), int(part["every"].iloc[0]), float(part["most_turnover"].iloc[0])
        book, out = Book(cash, lot), []
        for t, (day, rows) in enumerate(part.sort_values(["dt", "rank", "code"]).groupby("dt", sort=True)):
            rows = rows[rows["code"].notna() & (rows["close"] > 0)]
            today = {c: r for c, *r in rows[["code", "rank", *OPTIONAL]].itertuples(index=False)}
            book.price |= dict(zip(rows["code"], rows["close"]))
            for code in [c for c in book.shares if c in today]:
                dividend, bonus = (0.0 if pd.isna(x) else float(x) for x in today[code][4:6])
                if dividend or bonus:
                    book.pay_out(code, day, dividend, bonus)
            turnover, buys, sells, book.cost = 0.0, 0, 0, 0.0
            if t % every == 0:
                value = book.value()
                old = {c: k * book.price[c] / value for c, k in book.shares.items()}
                new = {c: 1 / n for c, r in today.items() if r[0] <= n}
                change = {c: new.get(c, 0.0) - old.get(c, 0.0) for c in dict.fromkeys([*new, *old])}
                turnover = sum(map(abs, change.values())) / 2
                scale = min(1.0, most / turnover) if turnover > 0 else 1.0
                goal = {c: old.get(c, 0.0) + scale * x for c, x in change.items()}
                wanted = {c: 0 if w <= 1e-12 else int(w * value / book.price[c] / lot + 1e-9) * lot for c, w in goal.items()}
                for code in sorted(old):
                    flags = today.get(code)
                    if flags and wanted[code] < book.shares[code] and not (flags[2] is True or flags[3] is True) and book.since[code] < day:
                        book.sell(code, book.shares[code] - wanted[code])
                        sells += 1
                for code in new:  # by rank
                    flags = today[code]
                    if wanted[code] > book.shares.get(code, 0) and not (flags[1] is True or flags[3] is True):
                        buys += book.buy(code, wanted[code] - book.shares.get(code, 0), day, buffer * value)
            out.append((key[0], day, book.value(), book.cash, len(book.shares), turnover, book.cost, buys, sells))
        return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return trading_rows(df, configs).groupBy("config_id").applyInPandas(fold, RESULT)


def market_flags(df: DataFrame, limit: float = 0.1) -> DataFrame:
    """limit_up, limit_down and suspended of bars with ret and volume."""
    return df.withColumns({"limit_up": F.col("ret") >= limit, "limit_down": F.col("ret") <= -limit, "suspended": F.coalesce(F.col("volume") == 0, F.lit(True))})
