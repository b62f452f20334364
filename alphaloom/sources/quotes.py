"""Quote pages as text: one assignment of comma-separated fields for each security."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of the fields in a quote (fixed values).
FIELDS = {"open": 1, "pre_close": 2, "price": 3, "high": 4, "low": 5, "volume": 8, "amount": 9}
LEAST_FIELDS = 32


def quote_code(code: str = "ts_code"):
    """The page's code of a security: sh or sz before its digits; without a market, those that begin with 6 are sh."""
    c = F.col(code)
    digits, market = F.split_part(c, F.lit("."), F.lit(1)), F.split_part(c, F.lit("."), F.lit(2))
    market = F.when(c.contains("."), market).otherwise(F.when(c.startswith("6"), "SH").otherwise("SZ"))
    return F.concat(F.when(market == "SH", "sh").otherwise("sz"), digits)


def parse_quotes(pages: DataFrame, text: str = "text") -> DataFrame:
    """code, name and the numbers of ``FIELDS`` of every quote in the texts (other columns of ``pages`` stay).

    A page may hold several quotes, one a line. Quotes of under ``LEAST_FIELDS`` fields are left out; an empty field
    or one that is no number is null. Null and empty texts have no quotes.
    """
    line = F.explode(F.split(F.col(text), "\n")).alias("_line")
    found = pages.select(*(c for c in pages.columns if c != text), line)
    quote = 'var hq_str_([a-z0-9]+)="(.*)";'
    found = found.withColumns({"code": F.regexp_extract("_line", quote, 1), "_f": F.split(F.regexp_extract("_line", quote, 2), ",")}).filter((F.col("code") != "") & (F.size("_f") >= LEAST_FIELDS))
    numbers = {name: F.expr(f"try_cast(_f[{at}] AS DOUBLE)") for name, at in FIELDS.items()}
    return found.withColumns({"name": F.nullif(F.col("_f")[0], F.lit("")), **numbers}).drop("_line", "_f")
