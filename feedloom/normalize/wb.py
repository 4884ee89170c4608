"""wb: posts (from cards or plain), comments, creators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.codes import gender
from feedloom.functions.nested import present
from feedloom.functions.text import content_url, drop_text, strip_tags_short
from feedloom.functions.times import mail_china_text, mail_wallclock_epoch
from feedloom.normalize import payloads
from feedloom.normalize.common import Seen, context, extra, opened, reply_to, seen, text, with_replies
from feedloom.operators.filters import select_cards
from feedloom.sources.embedded import wb_note_payload


def _posted() -> list[Column]:
    # The stored epoch ignores the offset, the stored text applies it (as specified).
    return [
        mail_wallclock_epoch("created_at").alias("create_time"),
        mail_china_text("created_at").alias("create_date_time"),
    ]


def _account() -> list[Column]:
    return [
        F.col("user.id").alias("user_id"),
        text("user.screen_name", "").alias("nickname"),
        text("user.gender", "").alias("gender"),
        text("user.profile_url", "").alias("profile_url"),
        text("user.profile_image_url", "").alias("avatar"),
    ]


def normalize_note(df: DataFrame, as_of: Seen = None) -> DataFrame:
    df = opened(df, payloads.WB_NOTE)
    return df.select(
        F.col("id").alias("note_id"),
        strip_tags_short("text").alias("content"),
        *_posted(),
        text("attitudes_count", "0").alias("liked_count"),
        text("comments_count", "0").alias("comments_count"),
        text("reposts_count", "0").alias("shared_count"),
        seen(as_of),
        content_url("wb", "id").alias("note_url"),
        drop_text(text("region_name", ""), "发布于 ").alias("ip_location"),
        *_account(),
        context(df, "source_keyword").alias("source_keyword"),
    )


def page_notes(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Posts embedded in detail pages, as payloads."""
    keep = [c for c in df.columns if c != html_col]
    return df.select(*keep, F.explode(present(wb_note_payload(html_col))).alias("payload"))


def search_records(df: DataFrame) -> DataFrame:
    """Posts of search cards, at the top level and inside groups."""
    cards = select_cards(opened(df, payloads.WB_CARD))
    keep = [c for c in cards.columns if c not in ("card_type", "card_pos", "mblog")]
    return cards.where(F.col("mblog").isNotNull()).select(*keep, "mblog.*")


def normalize_comment(df: DataFrame, as_of: Seen = None) -> DataFrame:
    df = opened(df, payloads.WB_COMMENT)
    return df.select(
        F.col("id").alias("comment_id"),
        *_posted(),
        context(df, "requested_id").cast("string").alias("note_id"),
        strip_tags_short("text").alias("content"),
        text("total_number", "0").alias("sub_comment_count"),
        text("like_count", "0").alias("comment_like_count"),
        seen(as_of),
        drop_text(text("source", ""), "来自").alias("ip_location"),
        text("rootid", "").alias("parent_comment_id"),
        *_account(),
    )


def normalize_comment_tree(df: DataFrame, as_of: Seen = None) -> DataFrame:
    """Comments and the replies inside them; a reply without a root has its level-1 comment."""
    rows = with_replies(df, payloads.WB_COMMENT_TREE, "comments", "id")
    return normalize_comment(rows.withColumn("rootid", reply_to(F.col("rootid"))), as_of)


def normalize_creator(df: DataFrame, as_of: Seen = None, extras: bool = False) -> DataFrame:
    df = opened(df, payloads.WB_CREATOR)
    return df.select(
        context(df, "user_id").cast("string").alias("user_id"),
        F.col("screen_name").alias("nickname"),
        gender("wb", "gender").alias("gender"),
        F.col("avatar_hd").alias("avatar"),
        F.col("description").alias("desc"),
        drop_text(text("source", ""), "来自").alias("ip_location"),
        text("follow_count", "").alias("follows"),
        text("followers_count", "").alias("fans"),
        F.lit("").alias("tag_list"),
        seen(as_of),
        *extra(extras, code=F.col("gender")),
    )
