"""Search flow: keywords to capped contents, their capped comments, their words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Optional, Union

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.codes import PAGE_SIZES, REPLIES_COUNT
from feedloom.operators.filters import keyword_search, split_keywords
from feedloom.operators.ranking import daily_quota, first_pages
from feedloom.plans.comments import KEYS, discussion


BROADCAST_ROWS = 100_000  # most content keys sent to every executor


@dataclass(frozen=True)
class SearchCaps:
    """Limits of a search run (the defaults are the specified ones)."""

    contents_per_keyword: int = 200
    page_size: int = 20
    start_page: int = 1
    comments_per_content: int = 10
    count_replies: bool = False
    replies: bool = False
    days: Optional[tuple[str, str]] = None
    contents_per_day: Optional[int] = None
    zone: str = "UTC"
    top_words: int = 20

    @classmethod
    def of(cls, platform: str, **limits: int) -> SearchCaps:
        """The limits of one platform: its page size and its rule for replies."""
        rule = REPLIES_COUNT[platform]
        own = {"page_size": PAGE_SIZES[platform], "count_replies": bool(rule)}
        if rule is None:
            own["comments_per_content"] = 0  # no cap
        return cls(**{**own, **limits})


@dataclass(frozen=True)
class SearchResult:
    content: DataFrame
    comment: DataFrame
    words: DataFrame
    top: DataFrame
    replies: Optional[DataFrame] = None


def search(
    content: DataFrame,
    comment: DataFrame,
    keywords: Union[str, Sequence[str]],
    text_cols: Sequence[str] = ("title", "body"),
    order: Sequence[Column] = (),
    comment_order: Sequence[Column] = (),
    stop: Union[Iterable[str], DataFrame] = (),
    caps: SearchCaps = SearchCaps(),
) -> SearchResult:
    """Canonical content and comment tables in, result tables out (lazy but for replies).

    With ``caps.days`` (first and last day) the contents are those of each day in turn, at
    most ``contents_per_day`` a day, instead of pages. ``caps.replies`` adds what answers the
    kept comments, at any depth.

    Shuffles: one for the keyword cap, one for the comment cap and one for the counts,
    all pruned or partly aggregated before; the join broadcasts the capped contents
    while the caps keep them few.
    """
    order = list(order) or [F.desc("created_ts"), F.col("platform"), F.col("content_id")]
    tagged = keyword_search(content, keywords, text_cols, key=KEYS)
    if caps.days:
        capped = daily_quota(
            tagged, ["source_keyword"], "created_ts", order, *caps.days, caps.contents_per_day,
            caps.contents_per_keyword, caps.zone,
        )
    else:
        capped = first_pages(
            tagged, ["source_keyword"], order, caps.page_size, caps.contents_per_keyword,
            caps.start_page,
        )
    pages = max(caps.contents_per_keyword, caps.page_size)
    # The caps bound the wanted contents, so the comments need not move for the join.
    few = pages * len(split_keywords(keywords)) <= BROADCAST_ROWS
    found = discussion(
        capped, comment, caps.comments_per_content, caps.count_replies, caps.replies, comment_order, stop,
        caps.top_words, few,
    )
    return SearchResult(capped, found.comment, found.words, found.top, found.replies)
