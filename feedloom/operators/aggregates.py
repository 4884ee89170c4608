"""Counts, distinct rows, latest values, per-key aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.nested import ColumnOrName, col
from feedloom.operators.ranking import Order, latest


def counts_by(df: DataFrame, keys: Sequence[ColumnOrName], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def dedupe(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """One row per natural key: the first in ``order``. Pruned map-side."""
    return latest(df, keys, order)


def first_last_seen(
    df: DataFrame, keys: Sequence[str], ts: str, payload: Sequence[str], tie: Sequence[str]
) -> DataFrame:
    """Per key: first and last time seen, and the payload of the last (ts, tie) row.

    Partial aggregates are merged, so a hot key reaches a task as one row per mapper.
    """
    newest = F.max_by(F.struct(*payload), F.struct(ts, *tie))
    return (
        df.groupBy(*keys)
        .agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), newest.alias("_last"))
        .select(*keys, "first_seen", "last_seen", "_last.*")
    )


def latest_unexpired(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ts: str,
    ttl: Column,
    as_of: Column,
    tie: Sequence[str] = (),
) -> DataFrame:
    """The value last set per key up to ``as_of``, if its time to live has not run out.

    ``ttl`` is an interval column (or a literal interval). A later set replaces an
    earlier one even when it expires sooner.
    """
    until = df.where(F.col(ts) <= as_of).withColumn("_expires", F.col(ts) + ttl)
    last = until.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(value), F.col(ts), F.col("_expires")), F.struct(ts, *tie)).alias(
            "_last"
        )
    )
    return last.where(F.col("_last._expires") >= as_of).select(
        *keys, F.col("_last")[value].alias(value), F.col("_last")[ts].alias(ts)
    )


def keys_like(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """Distinct keys that match: ``*`` is all, otherwise a substring (stars ignored)."""
    part = pattern.replace("*", "")
    kept = df.where(F.contains(F.col(key), F.lit(part))) if part else df
    return kept.select(key).distinct()


def pivot_types(
    df: DataFrame, keys: Sequence[str], kind: str, count: str, types: Sequence[str], order: Order
) -> DataFrame:
    """Rows of (type, count) as one column per type, 0 where a type is absent.

    The last count of a type in ``order`` wins (``order`` ascending).
    """
    position = F.struct(*order)
    columns = [
        F.coalesce(
            F.max_by(F.when(F.col(kind) == t, F.col(count)), F.when(F.col(kind) == t, position)),
            F.lit(0).cast("bigint"),
        ).alias(t)
        for t in types
    ]
    return df.groupBy(*keys).agg(*columns)


def next_run_ordinal(names: DataFrame, column: ColumnOrName = "name", strict: bool = False) -> DataFrame:
    """One row, ``ordinal``: the largest leading number of the file names, plus one.

    ``strict``: any name without a leading number resets the ordinal to 1.
    """
    lead = F.split_part(col(column), F.lit("_"), F.lit(1)).try_cast("int")
    top = F.coalesce(F.max(lead), F.lit(0)) + 1
    if strict:
        odd = F.coalesce(F.bool_or(lead.isNull()), F.lit(False))
        top = F.when(odd, 1).otherwise(top)
    return names.agg(top.cast("bigint").alias("ordinal"))
