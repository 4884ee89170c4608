"""Joins between seeds, contents, comments, creators and code tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Optional

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.nested import ColumnOrName, col, zip_columns
from feedloom.functions.text import IMAGE_HOSTS
from feedloom.operators.bloom import semi_filtered
from feedloom.operators.ranking import first_n
from feedloom.operators.skew import balanced_join
from feedloom.session import is_small


def details(content: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Contents named by a seed list. Catalyst broadcasts the seeds when they are small."""
    return content.join(seeds.select(key).distinct(), [key], "left_semi")


def missing(seeds: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """Seeds without a content.

    Only the key column of the contents is read, and of its rows only those that may be a
    seed's are exchanged, each mapper sending a key once: a creator with very many contents
    costs no task much. Seeds that Catalyst can broadcast, and streams, need no filter; a
    seed without a key is missing.
    """
    keys = wanted_only(content.select(key), seeds.select(key), key)
    return seeds.join(keys.distinct(), [key], "left_anti")


def wanted_only(content: DataFrame, seeds: DataFrame, key: str, rows: Optional[int] = None) -> DataFrame:
    """The contents whose ``key`` is a seed's, and few others: small seeds are joined where the
    contents are read, larger ones become a Bloom filter there. ``rows`` is about how many
    seeds there are; without it they are counted."""
    if content.isStreaming or seeds.isStreaming:
        return content
    distinct = seeds.select(key).na.drop().distinct()
    if is_small(seeds):
        return content.join(F.broadcast(distinct), [key], "left_semi")
    return semi_filtered(content, distinct, [key], distinct.count() if rows is None else rows)


def contents_of(
    creators: DataFrame,
    content: DataFrame,
    creator_key: str,
    content_creator: str,
    order: Optional[Sequence[Column]] = None,
    limit: int = 0,
    kinds: Optional[Sequence[str]] = None,
    kind_col: str = "content_type",
    scatter_by: Optional[Sequence[str]] = None,
) -> DataFrame:
    """Contents of the given creators, at most ``limit`` per creator (0 = all).

    ``scatter_by`` is the content id: it spreads the contents of a hot creator.

    Contents of other creators are dropped where they are read, as far as a filter of the
    creators can tell them; then the cap is pruned map-side, so the join sees the survivors.
    """
    if kinds:
        content = content.where(F.col(kind_col).isin(*kinds))
    if limit:
        named = creators.select(F.col(creator_key).alias(content_creator))
        content = wanted_only(content, named, content_creator)
    if limit:
        if not order:
            raise ValueError("a cap needs an order")
        content = first_n(content, [content_creator], order, limit)
    if creator_key != content_creator:
        content = content.withColumn(creator_key, F.col(content_creator))
    return balanced_join(content, creators, [creator_key], scatter_by=scatter_by)


def comments_of(
    content: DataFrame,
    comment: DataFrame,
    on: Sequence[str],
    take: Sequence[str] = (),
    scatter_by: Optional[Sequence[str]] = None,
) -> DataFrame:
    """Comments of the given contents, with the ``take`` columns of their content.

    ``scatter_by`` is the comment id: it spreads the comments of a viral content.
    """
    return balanced_join(comment, content.select(*on, *take), on, scatter_by=scatter_by)


def attach_parent(
    comment: DataFrame,
    inherit: Sequence[str],
    keys: Sequence[str] = ("platform", "content_id"),
    id_col: str = "comment_id",
    parent_col: str = "parent_comment_id",
    prefix: str = "parent_",
) -> DataFrame:
    """Every comment with columns of its parent (NULL for level 1)."""
    parents = comment.select(
        *keys,
        F.col(id_col).alias(parent_col),
        *[F.col(c).alias(f"{prefix}{c}") for c in inherit],
    )
    return balanced_join(
        comment, parents, [*keys, parent_col], "left", scatter_by=[*keys, id_col]
    )


def resolve_author(df: DataFrame, users: Column, key: ColumnOrName) -> DataFrame:
    """Add ``author`` from a map of users held by the same row."""
    return df.withColumn("author", F.try_element_at(users, col(key)))


def decode(
    df: DataFrame, code: ColumnOrName, labels: Mapping[str, str], name: str, default: Optional[str] = None
) -> DataFrame:
    """Add the label of a code from a small literal map."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    label = F.try_element_at(F.create_map(*pairs), col(code).cast("string"))
    return df.withColumn(name, F.coalesce(label, F.lit(default).cast("string")))


def decode_from(df: DataFrame, codes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add labels from a code table; unknown codes give NULL."""
    return df.join(codes, list(on), "left")


def explode_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Two parallel lists as rows of pairs; the shorter list is filled with NULL."""
    keep = [c for c in df.columns if c not in (left, right)]
    pairs = F.explode(zip_columns(left, right)).alias("_pair")
    return df.select(*keep, pairs).select(
        *keep, F.col("_pair.left").alias(left), F.col("_pair.right").alias(right)
    )


def expand_hosts(
    df: DataFrame, asset: str, hosts: Sequence[str] = tuple(IMAGE_HOSTS), image_format: str = "png"
) -> DataFrame:
    """Every asset on every host: a literal array of hosts, no join."""
    urls = F.explode(F.array(*[F.lit(h) for h in hosts]))
    tail = f"?imageView2/format/{image_format}"
    return df.withColumn("host", urls).withColumn(
        "asset_url", F.concat("host", F.lit("/"), F.col(asset), F.lit(tail))
    )


def prefer(primary: DataFrame, fallback: DataFrame, key: Sequence[str]) -> DataFrame:
    """The primary record per key, else the fallback's; NULL columns are filled from it."""
    a = primary.select(*key, F.struct(*[c for c in primary.columns if c not in key]).alias("_a"))
    b = fallback.select(*key, F.struct(*[c for c in fallback.columns if c not in key]).alias("_b"))
    rest = [c for c in primary.columns if c not in key]
    joined = a.join(b, list(key), "full_outer")
    have = set(fallback.columns)
    return joined.select(
        *key,
        *[
            (
                F.coalesce(F.col("_a")[c], F.col("_b")[c]) if c in have else F.col("_a")[c]
            ).alias(c)
            for c in rest
        ],
    )
