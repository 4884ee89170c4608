"""Named orders of content and comment lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Optional, Union

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.codes import SORT_CODES, CommentOrder, ContentOrder
from feedloom.functions.nested import ColumnOrName, col

# Canonical columns each order sorts on, first to last; "-" is descending.
_CONTENT_KEYS = {
    ContentOrder.MOST_LIKED: ("-like_count",),
    ContentOrder.LATEST: ("-created_ts",),
    ContentOrder.OLDEST: ("created_ts",),
    ContentOrder.MOST_CLICKED: ("-view_count",),
    ContentOrder.MOST_DANMAKU: ("-danmaku_count",),
    ContentOrder.MOST_COLLECTED: ("-collect_count",),
}
_COMMENT_KEYS = {
    CommentOrder.HEAT: ("-like_count",),
    CommentOrder.HEAT_THEN_TIME: ("-like_count", "-created_ts"),
    CommentOrder.TIME: ("-created_ts",),
}


def _sort(names: Sequence[str], columns: Mapping[str, str]) -> list[Column]:
    out = []
    for name in names:
        plain = name.lstrip("-")
        c = F.col(columns.get(plain, plain))
        out.append(c.desc() if name.startswith("-") else c.asc())
    return out


def keyword_hits(text: ColumnOrName, keyword: ColumnOrName) -> Column:
    """How often the keyword occurs in the text (any case, not overlapping)."""
    low, key = F.lower(col(text)), F.lower(col(keyword))
    removed = F.length(low) - F.length(F.replace(low, key, F.lit("")))
    return F.floor(removed / F.nullif(F.length(key), F.lit(0))).cast("bigint")


def content_order(
    how: Union[ContentOrder, tuple[str, str]],
    key: ColumnOrName = "content_id",
    columns: Optional[Mapping[str, str]] = None,
    text: ColumnOrName = "body",
    keyword: ColumnOrName = "source_keyword",
) -> list[Column]:
    """Sort columns of a named order, ended by the key.

    ``how`` is a ContentOrder or a (platform, sort code) pair. The general and
    relevance orders are by keyword hits, then newest first.
    """
    if not isinstance(how, ContentOrder):
        how = SORT_CODES[how]
    columns = columns or {}
    if how in (ContentOrder.GENERAL, ContentOrder.RELEVANCE):
        newest = F.col(columns.get("created_ts", "created_ts")).desc()
        return [keyword_hits(text, keyword).desc(), newest, col(key).asc()]
    return [*_sort(_CONTENT_KEYS[how], columns), col(key).asc()]


def comment_order(
    how: CommentOrder, key: ColumnOrName = "comment_id", columns: Optional[Mapping[str, str]] = None
) -> list[Column]:
    return [*_sort(_COMMENT_KEYS[how], columns or {}), col(key).asc()]


def order_content(df: DataFrame, how, **options) -> DataFrame:
    return df.orderBy(*content_order(how, **options))


def order_comments(df: DataFrame, how: CommentOrder, **options) -> DataFrame:
    return df.orderBy(*comment_order(how, **options))
