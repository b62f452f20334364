"""The register of queries: name -> DataFrame builder, DuckDB text, key and value columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    build: Builder
    sql: str | None
    keys: list[str]
    values: list[str]
    digits: int

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Keys as they are, values as doubles rounded alike on both sides."""
        rounded = [(F.round(F.col(v).cast("double"), self.digits) + F.lit(0.0)).alias(v) for v in self.values]
        return self.build(spark, sf_dir).select(*self.keys, *rounded)

    @property
    def text(self) -> str | None:
        if self.sql is None:
            return None
        values = [f"round(CAST({v} AS DOUBLE), {self.digits}) + 0.0 AS {v}" for v in self.values]
        with_part, _, body = self.sql.rpartition("---")
        return f"{with_part} SELECT {', '.join([*self.keys, *values])} FROM ({body}) AS q"


QUERIES: dict[str, Query] = {}


def query(keys: str, values: str, sql: str | None = None, digits: int = 6) -> Callable[[Builder], Builder]:
    """Register the decorated builder under its name. ``sql`` is 'WITH ... --- SELECT ...'; the part after the dashes is the result."""

    def add(f: Builder) -> Builder:
        QUERIES[f.__name__] = Query(f, sql, keys.split(), values.split(), digits)
        return f

    return add
