"""Comments, replies and words of the contents that a flow has found."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Optional, Union

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.operators.joins import comments_of
from feedloom.operators.ranking import first_n
from feedloom.operators.trees import reply_tree
from feedloom.operators.words import top_words, word_freq

KEYS = ["platform", "content_id"]


@dataclass(frozen=True)
class Discussion:
    """Level-1 comments, the replies below them if asked for, and the words of both."""

    comment: DataFrame
    replies: Optional[DataFrame]
    words: DataFrame
    top: DataFrame


def discussion(
    content: DataFrame,
    comment: DataFrame,
    per_content: int = 10,
    count_replies: bool = False,
    replies: bool = False,
    order: Sequence[Column] = (),
    stop: Union[Iterable[str], DataFrame] = (),
    top: int = 20,
    few: bool = False,
) -> Discussion:
    """Canonical comments of the given contents, at most ``per_content`` of level 1 each.

    With ``replies`` also all that answers a kept comment, at any depth, with its ``root_id``
    and ``depth``; that runs the rounds of ``reply_tree``, all else is lazy. ``few`` says that
    the caps of the flow bound the contents, which are then sent to the comments.
    """
    order = list(order) or [F.col("created_ts"), F.col("comment_id")]
    wanted = content.select(*KEYS).distinct()

    def of_wanted(rows: DataFrame) -> DataFrame:
        if few:
            return rows.join(F.broadcast(wanted), KEYS, "left_semi")
        return comments_of(wanted, rows, KEYS, scatter_by=["comment_id"])

    level1 = of_wanted(comment.where(F.col("parent_comment_id").isNull()))
    kept = first_n(level1, KEYS, order, per_content, "sub_comment_count" if count_replies else None)
    below, texts = None, kept.select("body")
    if replies:
        # a reply whose parent is not there hangs below no comment
        tree = reply_tree(of_wanted(comment), scope=KEYS, no_parent=())
        roots = kept.select(*KEYS, F.col("comment_id").alias("root_id"))
        below = tree.where("depth > 1").join(roots, [*KEYS, "root_id"], "left_semi").drop("path", "orphan")
        texts = texts.unionByName(below.select("body"))
    words = word_freq(texts, "body", stop)
    return Discussion(kept, below, words, top_words(words, top))
