"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Optional

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.session import estimated_bytes, is_small

SALTS = 64           # pieces a hot key is split into
HOT_TRACKED = 1000   # counters of the heavy-hitter sketch, per task
HOT_KEYS = 100       # most keys that can be called hot: bounds what every task gets
HOT_SHARE = 0.01     # a key is hot from this share of the rows on
SALT_FROM_BYTES = 4 << 30  # below this size no single task can get too much


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> Column:
    """Hashes of the keys that own at least ``share`` of the rows, as one array value.

    One pass over the key columns with a mergeable sketch; nothing is shuffled but
    the sketches. The sketch never misses a key above its error bound and serves
    only to place rows: results do not depend on it.
    """
    counted = df.select(F.xxhash64(*keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {HOT_KEYS}, {HOT_TRACKED})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    )
    hot = F.transform(
        F.filter("top", lambda t: t["count"] >= F.col("n") * share), lambda t: t["item"]
    )
    return counted.select(hot.alias("hot")).scalar()


def balanced_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    salt_from_bytes: int = SALT_FROM_BYTES,
    share: float = HOT_SHARE,
    scatter_by: Optional[Sequence[str]] = None,
    always: bool = False,
) -> DataFrame:
    """Equi-join ``big`` with ``small``, splitting the hot keys of ``big``.

    A ``small`` that Catalyst broadcasts needs no care, and up to ``salt_from_bytes``
    adaptive execution splits skewed partitions: both are plain joins, as are those of
    a stream, whose micro-batches are small. Above, rows of a hot key are spread over
    ``salts`` pieces and the (few) matching rows of ``small`` are repeated once per
    piece; all other rows are untouched.

    ``how`` is inner, left, left_semi or left_anti, seen from ``big``.
    ``scatter_by`` names the columns whose hash spreads a hot key (a row id is best;
    by default all columns, which makes the scan read them). ``always`` salts at any size.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} cannot be salted")
    on = list(on)
    if big.isStreaming or (
        not always and (estimated_bytes(big) < salt_from_bytes or is_small(small))
    ):
        return big.join(small, on, how)
    hot = hot_keys(big, on, share)
    is_hot = F.coalesce(F.array_contains(hot, F.xxhash64(*on)), F.lit(False))
    # A hash of the row, not a random number: a repeated task must place rows alike.
    spread_over = scatter_by or [c for c in big.columns if _hashable(big, c)]
    scatter = F.pmod(F.xxhash64(*spread_over), F.lit(salts))
    pieces = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = big.withColumn("_salt", F.when(is_hot, scatter.cast("int")).otherwise(F.lit(0)))
    repeated = small.withColumn("_salt", F.explode(pieces))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType.simpleString()
    return "map<" not in kind and "variant" not in kind
