"""xhs: notes, comments, creators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.codes import gender
from feedloom.functions.nested import (
    entries_to_map,
    join_list,
    map_json,
    parse_any_case,
    present,
    text_or,
    typed_value,
)
from feedloom.functions.text import VIDEO_HOST, content_url, truncate
from feedloom.normalize import payloads
from feedloom.normalize.common import Seen, context, extra, opened, reply_to, seen, text, with_replies
from feedloom.schemas import struct
from feedloom.sources.embedded import xhs_creator_payload, xhs_note_payload


def image_url(image: Column) -> Column:
    """The default rendition, else the plain URL."""
    return text_or(image["url_default"], image["url"])


def video_urls() -> Column:
    """URLs of a video note: one from its key, else the h264 renditions; [] for others."""
    key = text_or(
        F.col("video.consumer.origin_video_key"),
        F.nullif(F.col("video.consumer.originVideoKey"), F.lit("")),
    )
    renditions = F.transform(F.col("video.media.stream.h264"), lambda v: v["master_url"])
    none = F.array().cast("array<string>")
    return F.when(
        F.col("type") == "video",
        F.when(key.isNotNull(), F.array(F.concat(F.lit(f"{VIDEO_HOST}/"), key))).otherwise(
            F.coalesce(renditions, none)
        ),
    ).otherwise(none)


def normalize_note(df: DataFrame, as_of: Seen = None, extras: bool = False) -> DataFrame:
    df = opened(df, payloads.XHS_NOTE)
    topics = F.transform(
        F.filter("tag_list", lambda t: t["type"] == "topic"), lambda t: t["name"]
    )
    images = F.transform("image_list", image_url)
    return df.select(
        "note_id",
        "type",
        text_or("title", truncate(text("desc", ""), 255)).alias("title"),
        text("desc", "").alias("desc"),
        join_list(video_urls()).alias("video_url"),
        "time",
        F.coalesce("last_update_time", F.lit(0).cast("bigint")).alias("last_update_time"),
        F.col("user.user_id").alias("user_id"),
        F.col("user.nickname").alias("nickname"),
        F.col("user.avatar").alias("avatar"),
        F.col("interact_info.liked_count").alias("liked_count"),
        F.col("interact_info.collected_count").alias("collected_count"),
        F.col("interact_info.comment_count").alias("comment_count"),
        F.col("interact_info.share_count").alias("share_count"),
        text("ip_location", "").alias("ip_location"),
        join_list(images).alias("image_list"),
        join_list(topics).alias("tag_list"),
        seen(as_of),
        F.concat(
            content_url("xhs", "note_id"),
            F.lit("?xsec_token="),
            text("xsec_token", ""),
            F.lit("&xsec_source=pc_search"),
        ).alias("note_url"),
        context(df, "source_keyword").alias("source_keyword"),
        "xsec_token",
        *extra(extras, {"video_url": video_urls(), "image_list": images, "tag_list": topics}),
    )


def page_notes(df: DataFrame, html_col: str = "html", note_id: str = "note_id") -> DataFrame:
    """Notes embedded in detail pages, as payload fields (the page's names are camel case)."""
    keep = [c for c in df.columns if c not in (html_col, note_id)]
    found = df.select(*keep, F.explode(present(xhs_note_payload(html_col, note_id))).alias("_record"))
    notes = parse_any_case(found, "_record", struct(payloads.XHS_NOTE), "_note")
    return notes.select(*keep, F.inline(present("_note")))


def page_creators(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Creators embedded in profile pages, as payloads (``user_id`` stays beside them)."""
    keep = [c for c in df.columns if c != html_col]
    return df.select(*keep, F.explode(present(xhs_creator_payload(html_col))).alias("payload"))


def normalize_comment(df: DataFrame, as_of: Seen = None, extras: bool = False) -> DataFrame:
    """Comments; the note they were requested for (``requested_id``) is their note."""
    df = opened(df, payloads.XHS_COMMENT)
    note = F.coalesce(context(df, "requested_id").cast("string"), F.col("note_id"))
    pictures = F.transform("pictures", lambda p: p["url_default"])
    return df.select(
        F.col("id").alias("comment_id"),
        "create_time",
        "ip_location",
        note.alias("note_id"),
        "content",
        F.col("user_info.user_id").alias("user_id"),
        F.col("user_info.nickname").alias("nickname"),
        F.col("user_info.image").alias("avatar"),
        text("sub_comment_count", "0").alias("sub_comment_count"),
        join_list(pictures).alias("pictures"),
        text("target_comment.id", "0").alias("parent_comment_id"),
        seen(as_of),
        text("like_count", "0").alias("like_count"),
        *extra(extras, {"pictures": pictures}),
    )


def normalize_comment_tree(df: DataFrame, as_of: Seen = None, extras: bool = False) -> DataFrame:
    """Comments and the replies inside them; a reply that names no target answers its
    level-1 comment, whose note it shares."""
    rows = with_replies(df, payloads.XHS_COMMENT_TREE, "sub_comments", "id")
    target = F.struct(reply_to(F.col("target_comment.id")).alias("id"))
    return normalize_comment(rows.withColumn("target_comment", target), as_of, extras)


def normalize_creator(df: DataFrame, as_of: Seen = None, extras: bool = False) -> DataFrame:
    """Creators; ``user_id`` comes from the request, not from the payload."""
    df = opened(df, payloads.XHS_CREATOR)

    def interaction(name: str) -> Column:
        return text(typed_value("interactions", name), "0")

    return df.select(
        context(df, "user_id").cast("string").alias("user_id"),
        F.col("basicInfo.nickname").alias("nickname"),
        gender("xhs", "basicInfo.gender").alias("gender"),
        F.col("basicInfo.images").alias("avatar"),
        F.col("basicInfo.desc").alias("desc"),
        F.col("basicInfo.ipLocation").alias("ip_location"),
        interaction("follows").alias("follows"),
        interaction("fans").alias("fans"),
        interaction("interaction").alias("interaction"),
        map_json(entries_to_map("tags", "tagType", "name")).alias("tag_list"),
        seen(as_of),
        *extra(extras, code=F.col("basicInfo.gender")),
    )
