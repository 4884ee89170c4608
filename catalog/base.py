"""Registry of queries and oracles, and small helpers for building payloads."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SEEN = 1_700_000_000_000  # injected clock of the normaliser queries


def query(name: str, sql: Optional[str] = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its oracle SQL if there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def s(c) -> Column:
    """A column (or literal Column) as text."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def text(*parts) -> Column:
    """Concatenation; ``str`` parts are literals, Columns are cast to text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def record(**fields) -> Column:
    """Struct of named columns."""
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def landed(df: DataFrame, *context: str, **fields) -> DataFrame:
    """Rows as landed JSON texts: context columns and ``payload``. NULL fields are absent."""
    return df.select(*context, F.to_json(record(**fields)).alias("payload"))
