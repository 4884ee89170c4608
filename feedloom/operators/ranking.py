"""Caps per group, page slices and latest rows.

Every operator takes a total order (end it with a unique key). Groups may be of any
size: up to ``group_limit`` rows a cap is pruned on the map side (``WindowGroupLimit``),
so that no task receives a whole group; beyond it positions are computed piecewise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedloom.functions.codes import REPLIES_COUNT
from feedloom.functions.nested import ColumnOrName, col
from feedloom.operators.filters import in_day_range
from feedloom.session import cut_lineage

SALTED_FROM = 200   # larger caps are pruned in two rounds
SALTS = 64
TOP_ROWS = 10_000    # most rows a single top-k task may hold

Order = Sequence[Column]


def group_limit(spark: SparkSession) -> int:
    """Largest cap that Spark prunes on the map side (-1: none)."""
    return int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def ranked(
    df: DataFrame, keys: Sequence[str], order: Order, n: int, name: str = "position"
) -> DataFrame:
    """The first ``n`` rows per key with their position (1-based)."""
    if not keys and n <= TOP_ROWS:
        df = df.orderBy(*order).limit(n)
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    if not keys or n > group_limit(df.sparkSession):
        return numbered(df, keys, order, name).where(F.col(name) <= n)
    if n > SALTED_FROM:
        # Each map task may send n rows of a hot key, which for a large n is too much
        # for one task. A first round caps salted pieces of the groups: the first n of
        # a group are among the first n of their pieces.
        piece = F.pmod(F.spark_partition_id(), F.lit(SALTS))
        salted = df.withColumn("_piece", piece)
        window = Window.partitionBy(*keys, "_piece").orderBy(*order)
        df = (
            salted.withColumn("_rank", F.row_number().over(window))
            .where(F.col("_rank") <= n)
            .drop("_rank", "_piece")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Order, name: str = "position"
) -> DataFrame:
    """Exact position of every row in its group, for groups of any size.

    Rows are range-partitioned by (keys, order), so a hot group spans many tasks;
    the position is the rank inside a piece plus the sizes of the earlier pieces.
    The pieces are written out first: a recomputed range partitioning could draw
    other borders.
    """
    spark = df.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(pieces, *[F.col(k).asc() for k in keys], *order)
    placed = cut_lineage(ranges.withColumn("_piece", F.spark_partition_id()))
    group = [*keys, "_piece"]
    local = placed.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    )
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = before.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first key of a piece can have rows in an earlier piece, so at most
    # ``pieces`` rows have an offset: small enough to broadcast at any scale.
    offsets = (
        sizes.withColumn("_offset", F.sum("_size").over(earlier))
        .where(F.col("_offset") > 0)
        .select(*[F.col(g).alias(f"_{i}") for i, g in enumerate(group)], "_offset")
    )
    match = reduce(
        lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_{i}")) for i, g in enumerate(group)]
    )
    joined = local.join(F.broadcast(offsets), match, "left")
    position = F.col("_local") + F.coalesce("_offset", F.lit(0))
    return joined.select(*df.columns, position.alias(name))


def first_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    n: int,
    children: Optional[ColumnOrName] = None,
) -> DataFrame:
    """The first ``n`` rows per key; ``n`` of 0 or less means no cap.

    With ``children`` (a count column) a row's children also use up the cap: a row
    is kept while rows and children before it number less than ``n``. A row weighs
    at least one, so none beyond position ``n`` can stay: the running sum only ever
    sees ``n`` rows per key.
    """
    if n <= 0:
        return df
    top = ranked(df, keys, order, n, "_position")
    if children is None:
        return top.drop("_position")
    weight = F.lit(1) + F.coalesce(col(children).cast("bigint"), F.lit(0).cast("bigint"))
    before = (
        Window.partitionBy(*keys)
        .orderBy("_position")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    used = F.coalesce(F.sum(weight).over(before), F.lit(0))
    return top.withColumn("_used", used).where(F.col("_used") < n).drop("_used", "_position")


def cap_comments(
    df: DataFrame,
    platform: str,
    keys: Sequence[str],
    order: Order,
    n: int,
    children: ColumnOrName = "sub_comment_count",
) -> DataFrame:
    """Level-1 comments per content under the rule of their platform."""
    counts = REPLIES_COUNT[platform]
    if counts is None:
        return df
    return first_n(df, keys, order, n, children if counts else None)


def first_pages(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    page_size: int,
    n: int,
    start_page: int = 1,
) -> DataFrame:
    """Whole pages per key: pages p with ``(p - start_page + 1) * page_size <= max(n, page_size)``."""
    pages = max(n, page_size) // page_size
    skipped = (start_page - 1) * page_size
    top = ranked(df, keys, order, skipped + pages * page_size, "_position")
    page_no = F.ceil(F.col("_position") / page_size).cast("bigint")
    return (
        top.where(F.col("_position") > skipped)
        .withColumn("page", page_no)
        .drop("_position")
    )


def daily_quota(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Order,
    start: str,
    end: str,
    per_day: Optional[int] = None,
    total: Optional[int] = None,
    zone: str = "UTC",
) -> DataFrame:
    """Rows of a day range, at most ``per_day`` per day and ``total`` per key, day by day; days
    are those of ``zone``."""
    day = F.to_date(F.col(ts) if zone == "UTC" else F.from_utc_timestamp(F.col(ts), zone))
    out = in_day_range(df, ts, start, end, zone).withColumn("_day", day)
    if per_day is not None:
        out = ranked(out, [*keys, "_day"], order, per_day, "_rank").drop("_rank")
    if total is not None:
        out = ranked(out, keys, [F.col("_day"), *order], total, "_rank").drop("_rank")
    return out.drop("_day")


def latest(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """One row per key: the first in ``order`` (give it descending)."""
    return ranked(df, keys, order, 1, "_rank").drop("_rank")


def page(df: DataFrame, order: Order, page_no: int, size: int) -> DataFrame:
    """Page ``page_no`` (1-based) of the whole table in ``order``.

    A deep page is not cut from one task's top rows but from exact positions.
    """
    skip = (page_no - 1) * size
    if skip + size <= TOP_ROWS:
        return df.orderBy(*order).offset(skip).limit(size)
    at = numbered(df, [], order, "_position")
    return at.where((F.col("_position") > skip) & (F.col("_position") <= skip + size)).drop(
        "_position"
    )


def page_count(n: ColumnOrName, size: int = 10, style: str = "ceil") -> Column:
    """Pages of a child list. ``style='floor_plus_one'`` is one too many at whole multiples."""
    count = col(n).cast("bigint")
    if style == "ceil":
        return F.ceil(count / size).cast("bigint")
    if style == "floor_plus_one":
        return F.floor(count / size).cast("bigint") + 1
    raise ValueError(f"unknown page style {style!r}")

