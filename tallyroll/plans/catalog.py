"""Which queries there are: name, DataFrame form, SQL twin."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int | None = 4):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL twin.

    ``digits``: to how many places the DataFrame's doubles are rounded; in the SQL, ``r`` does it.
    """

    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            doubles = {c for c, t in df.dtypes if t in ("double", "float")} if digits is not None else set()
            return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


def r(expression: str, name: str, digits: int = 4) -> str:
    """A rounded double column of a SQL text."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {name}"
