"""Unions of comments, contact edges, sources and platforms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from feedloom.operators.ranking import Order, latest


def contact_edges(fans: DataFrame, followings: DataFrame, order: Order = ()) -> DataFrame:
    """Both edge lists as one directed table, one row per (up_id, fan_id).

    ``order`` picks the row of a repeated edge; without it the smallest row is taken,
    so that the result does not depend on partitioning.
    """
    edges = fans.unionByName(followings)
    keys = ["up_id", "fan_id"]
    rest = [c for c in edges.columns if c not in keys]
    if not rest:
        return edges.distinct()
    return latest(edges, keys, list(order) or [F.col(c) for c in rest])


def flatten_comments(df: DataFrame, child_field: str, shared: Sequence[str] = ()) -> DataFrame:
    """Level-1 comments and the replies nested in ``child_field``, as rows of one list.

    ``shared`` names columns of the level-1 row that its replies also get. Each row
    tells its ``level``. One pass over the input: no union, no second scan.
    """
    child_type = df.schema[child_field].dataType.elementType
    own = [c for c in df.columns if c != child_field and c not in shared]
    child_names = set(child_type.names)
    level1 = F.struct(F.lit(1).alias("level"), *own)
    level2 = F.transform(
        F.col(child_field),
        lambda x: F.struct(
            F.lit(2).alias("level"),
            *[
                (x[c] if c in child_names else F.lit(None).cast(df.schema[c].dataType)).alias(c)
                for c in own
            ],
        ),
    )
    empty = F.slice(F.array(level1), 1, 0)
    every = F.concat(F.array(level1), F.coalesce(level2, empty))
    return df.select(*shared, F.explode(every).alias("_row")).select(*shared, "_row.*")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of several sources; a column one of them lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


union_platforms = union_sources
