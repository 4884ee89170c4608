"""ks: videos, comments, creators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.codes import gender
from feedloom.functions.text import content_url, truncate
from feedloom.normalize import payloads
from feedloom.normalize.common import Seen, context, extra, opened, reply_to, seen, text, with_replies


def normalize_video(df: DataFrame, as_of: Seen = None) -> DataFrame:
    """Videos; a record without an id is dropped."""
    df = opened(df, payloads.KS_VIDEO, lambda p: F.length(p["photo"]["id"]) > 0)
    caption = truncate(text("photo.caption", ""), 500)
    return df.select(
        F.col("photo.id").alias("video_id"),
        text("type").alias("video_type"),
        caption.alias("title"),
        caption.alias("desc"),
        F.col("photo.timestamp").alias("create_time"),
        F.col("author.id").alias("user_id"),
        F.col("author.name").alias("nickname"),
        text("author.headerUrl", "").alias("avatar"),
        text("photo.realLikeCount").alias("liked_count"),
        F.col("photo.viewCount").alias("viewd_count"),
        seen(as_of),
        content_url("ks", "photo.id").alias("video_url"),
        text("photo.coverUrl", "").alias("video_cover_url"),
        text("photo.photoUrl", "").alias("video_play_url"),
        context(df, "source_keyword").alias("source_keyword"),
    )


def normalize_comment(df: DataFrame, as_of: Seen = None) -> DataFrame:
    return _comments(opened(df, payloads.KS_COMMENT), as_of)


def normalize_comment_tree(df: DataFrame, as_of: Seen = None) -> DataFrame:
    """Comments and the replies inside them, which answer their level-1 comment."""
    rows = with_replies(df, payloads.KS_COMMENT_TREE, "subComments", "commentId")
    return _comments(rows, as_of, text(reply_to(F.lit(None).cast("string")), "").alias("parent_comment_id"))


def _comments(df: DataFrame, as_of: Seen, *more: Column) -> DataFrame:
    return df.select(
        F.col("commentId").alias("comment_id"),
        F.col("timestamp").alias("create_time"),
        context(df, "requested_id").cast("string").alias("video_id"),
        "content",
        F.col("authorId").alias("user_id"),
        F.col("authorName").alias("nickname"),
        F.col("headurl").alias("avatar"),
        text("subCommentCount", "0").alias("sub_comment_count"),
        seen(as_of),
        *more,
    )


def normalize_creator(df: DataFrame, as_of: Seen = None, extras: bool = False) -> DataFrame:
    df = opened(df, payloads.KS_CREATOR)
    return df.select(
        context(df, "user_id").cast("string").alias("user_id"),
        F.col("profile.user_name").alias("nickname"),
        gender("ks", "profile.gender").alias("gender"),
        F.col("profile.headurl").alias("avatar"),
        F.col("profile.user_text").alias("desc"),
        F.lit("").alias("ip_location"),
        F.col("ownerCount.follow").alias("follows"),
        F.col("ownerCount.fan").alias("fans"),
        F.col("ownerCount.photo_public").alias("interaction"),
        seen(as_of),
        *extra(extras, code=F.col("profile.gender")),
    )
