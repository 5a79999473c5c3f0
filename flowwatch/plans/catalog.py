"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} is already registered")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double: summation order differs between engines."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(F.round(F.col(f"`{name}`").cast("double"), special.get(name, digits)).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return df.select(*out)
