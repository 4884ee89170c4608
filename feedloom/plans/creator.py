"""Creator flow: seeds to their contents, relations and activity posts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Optional, Union

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.operators.joins import contents_of, details, missing, wanted_only
from feedloom.operators.ranking import first_n
from feedloom.operators.sets import contact_edges
from feedloom.operators.skew import balanced_join
from feedloom.plans.comments import Discussion, discussion
from feedloom.session import is_small


@dataclass(frozen=True)
class CreatorCaps:
    """Limits per creator (0 = none; the defaults are the specified ones)."""

    contents: int = 0
    contacts: int = 100
    activities: int = 50
    comments_per_content: int = 10
    replies: bool = False


@dataclass(frozen=True)
class CreatorResult:
    content: DataFrame
    not_found: DataFrame
    edges: Optional[DataFrame]
    activity: Optional[DataFrame]
    creator: Optional[DataFrame] = None
    discussion: Optional[Discussion] = None


def _of(
    df: DataFrame, column: str, wanted: DataFrame, order: Sequence[Column], n: int, rows: Optional[int]
) -> DataFrame:
    """The first ``n`` rows (0: all) of each wanted author; those of a hot one are spread.

    Rows of other authors are dropped where they are read, as far as a filter can tell them, and
    the cap comes first: no task holds rows of its authors that the cap drops.
    """
    named = wanted.select(F.col("author_id").alias(column))
    if n > 0:
        df = first_n(wanted_only(df, named, column, rows), [column], order, n)
    return balanced_join(df, named, [column], "left_semi")


def creator_run(
    seeds: DataFrame,
    content: DataFrame,
    fans: Optional[DataFrame] = None,
    followings: Optional[DataFrame] = None,
    activity: Optional[DataFrame] = None,
    caps: CreatorCaps = CreatorCaps(),
    creator: Optional[DataFrame] = None,
    comment: Optional[DataFrame] = None,
    stop: Union[Iterable[str], DataFrame] = (),
) -> CreatorResult:
    """``seeds(author_id)``; canonical contents; fan and following edges and activity
    posts of the seeds; with canonical ``creator`` rows the seeds' profiles (``user_id``), with
    canonical ``comment`` rows the comments and words of their contents."""
    wanted = seeds.select("author_id").distinct()
    newest = [F.desc("created_ts"), F.col("platform"), F.col("content_id")]
    mine = contents_of(
        wanted, content, "author_id", "author_id", newest, caps.contents,
        scatter_by=["platform", "content_id"],
    )
    # sizes the filters only; seeds that Catalyst broadcasts need none
    rows = None if is_small(wanted) else wanted.count()
    edges = None
    if fans is not None and followings is not None:
        by_pair = [F.col("up_id"), F.col("fan_id")]
        edges = contact_edges(
            _of(fans, "up_id", wanted, by_pair, caps.contacts, rows),
            _of(followings, "fan_id", wanted, by_pair, caps.contacts, rows),
        )
    posts = None
    if activity is not None:
        newest_post = [F.desc("pub_ts"), F.col("activity_id")]
        posts = _of(activity, "user_id", wanted, newest_post, caps.activities, rows)
    profiles = None
    if creator is not None:
        profiles = details(creator, wanted.select(F.col("author_id").alias("user_id")), "user_id")
    said = None
    if comment is not None:
        said = discussion(mine, comment, caps.comments_per_content, replies=caps.replies, stop=stop)
    return CreatorResult(mine, missing(wanted, content, "author_id"), edges, posts, profiles, said)
