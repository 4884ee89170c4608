"""Reply trees of any depth: root, depth and path of every comment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from feedloom.operators.skew import balanced_join
from feedloom.session import remove, shared_path, stored

TREE = ("root_id", "depth", "path", "orphan")


def reply_tree(
    df: DataFrame,
    id_col: str = "comment_id",
    parent_col: str = "parent_comment_id",
    scope: Sequence[str] = ("platform", "content_id"),
    no_parent: Sequence[str] = ("", "0"),
) -> DataFrame:
    """The rows with ``root_id``, ``depth`` (1 for a root), ``path`` (ids from the root to the
    row) and ``orphan`` (its own parent is not among the rows).

    Ids are those of their ``scope``. A row without a parent (NULL, or a text of
    ``no_parent``), with itself as parent, or whose parent is not there, is the root of what
    hangs below it. Rows on a ring of parents or below one have no root: NULL in all but
    ``orphan``; so have rows without an id. Repeated rows keep their number; if they name
    different parents, the smallest counts.

    Pointer jumping: in each round every row that has not met its root takes over what the
    row it points at knows, so known paths double and a tree of depth d takes log2(d) rounds.
    A viral comment's replies are spread over tasks. Each round is written to the shared
    folder, and the one before it removed.
    """
    scope = list(scope)
    key = [*scope, "_id"]
    parent = F.col(parent_col)
    none = parent.cast("string").isin(*no_parent) if no_parent else F.lit(False)
    named = df.select(*scope, F.col(id_col).alias("_id"), F.when(~(none | (parent == F.col(id_col))), parent).alias("_up"))
    nodes = named.where(F.col("_id").isNotNull()).groupBy(*key).agg(F.min("_up").alias("_up"))
    # the scope may hold NULLs, which equal each other here
    nodes = nodes.select(F.struct(*scope, F.lit(0).alias("_")).alias("_s"), "_id", "_up")
    there = nodes.select("_s", F.col("_id").alias("_up"), F.lit(True).alias("_there"))
    nodes = balanced_join(nodes, there, ["_s", "_up"], "left", scatter_by=["_s", "_id"])
    first = nodes.select(
        "_s",
        "_id",
        F.when(F.col("_there"), F.col("_up")).alias("_up"),
        F.array("_id").alias("path"),
        (F.col("_up").isNotNull() & F.col("_there").isNull()).alias("orphan"),
    )
    spark, folder = df.sparkSession, shared_path(df.sparkSession, "tree")
    state = stored(first, folder)
    left = state.where(F.col("_up").isNotNull()).count()
    while left:
        known = state.select("_s", F.col("_id").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_above"))
        moving = state.where(F.col("_up").isNotNull())
        moved = balanced_join(moving, known, ["_s", "_up"], scatter_by=["_s", "_id"]).select(
            "_s", "_id", F.col("_next").alias("_up"), F.concat("_above", "path").alias("path"), "orphan"
        )
        # on a ring a path would double for ever: it is given up when it meets itself
        ring = F.col("_up").isNotNull() & F.array_contains("path", F.col("_up"))
        below = moved.withColumn("path", F.when(~ring, F.col("path")))
        below = below.withColumn("_up", F.when(F.col("path").isNotNull(), F.col("_up")))
        done, folder = folder, shared_path(spark, "tree")
        state = stored(state.where(F.col("_up").isNull()).unionByName(below), folder)
        remove(spark, done)
        left = state.where(F.col("_up").isNotNull()).count()
    found = state.select(
        "_s",
        F.col("_id").alias("_k"),
        F.element_at("path", 1).alias("root_id"),
        F.size("path").alias("depth"),
        "path",
        "orphan",
    )
    found = found.withColumn("depth", F.when(F.col("path").isNotNull(), F.col("depth")))
    rows = df.drop(*TREE).withColumns({"_s": F.struct(*scope, F.lit(0).alias("_")), "_k": F.col(id_col)})
    return balanced_join(rows, found, ["_s", "_k"], "left").drop("_s", "_k")
