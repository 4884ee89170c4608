"""dy: posts (from detail or search records), comments, creators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.codes import gender
from feedloom.functions.nested import (
    first_filled,
    item,
    join_list,
    last_of_many,
    present,
    second,
)
from feedloom.functions.text import content_url
from feedloom.normalize import payloads
from feedloom.normalize.common import Seen, context, extra, opened, seen, text


def search_records(df: DataFrame) -> DataFrame:
    """Search hits: the post itself, else the first of a mix; hits with neither dropped."""
    df = opened(df, payloads.DY_SEARCH)
    keep = [c for c in df.columns if c not in ("aweme_info", "aweme_mix_info")]
    post = F.coalesce("aweme_info", item("aweme_mix_info.mix_items", 1))
    return df.select(*keep, F.inline(present(post)))


def cover_url() -> Column:
    return text(second(first_filled("video.raw_cover.url_list", "video.origin_cover.url_list")), "")


def video_url() -> Column:
    streams = first_filled(
        "video.play_addr_h264.url_list",
        "video.play_addr_256.url_list",
        "video.play_addr.url_list",
    )
    return text(last_of_many(streams), "")


def image_urls() -> Column:
    """The last (unmarked) URL of every image that has one."""
    last = F.transform("images", lambda image: item(image["url_list"], -1))
    return F.filter(last, lambda u: u.isNotNull())


def comment_images() -> Column:
    picked = F.transform("image_list", lambda image: second(image["origin_url"]["url_list"]))
    return F.filter(picked, lambda u: u.isNotNull())


def _account(source: str) -> list[Column]:
    names = {
        "user_id": "uid",
        "sec_uid": "sec_uid",
        "short_user_id": "short_id",
        "user_unique_id": "unique_id",
        "user_signature": "signature",
        "nickname": "nickname",
    }
    return [F.col(f"{source}.{field}").alias(name) for name, field in names.items()]


def normalize_post(df: DataFrame, as_of: Seen = None, extras: bool = False) -> DataFrame:
    df = opened(df, payloads.DY_AWEME)
    return df.select(
        "aweme_id",
        text("aweme_type").alias("aweme_type"),
        text("desc", "").alias("title"),
        text("desc", "").alias("desc"),
        "create_time",
        *_account("author"),
        text(item("author.avatar_thumb.url_list", 1), "").alias("avatar"),
        text("statistics.digg_count").alias("liked_count"),
        text("statistics.collect_count").alias("collected_count"),
        text("statistics.comment_count").alias("comment_count"),
        text("statistics.share_count").alias("share_count"),
        text("ip_label", "").alias("ip_location"),
        seen(as_of),
        content_url("dy", "aweme_id").alias("aweme_url"),
        cover_url().alias("cover_url"),
        video_url().alias("video_download_url"),
        text("music.play_url.uri", "").alias("music_download_url"),
        join_list(image_urls()).alias("note_download_url"),
        context(df, "source_keyword").alias("source_keyword"),
        *extra(extras, {"note_download_url": image_urls()}),
    )


def normalize_comment(df: DataFrame, as_of: Seen = None, extras: bool = False) -> DataFrame:
    """Comments; see ``consistent_children`` for those of another post."""
    df = opened(df, payloads.DY_COMMENT)
    sizes = ("avatar_medium", "avatar_300x300", "avatar_168x168", "avatar_thumb")
    avatar = first_filled(*[f"user.{size}.url_list" for size in sizes])
    return df.select(
        F.col("cid").alias("comment_id"),
        "create_time",
        text("ip_label", "").alias("ip_location"),
        "aweme_id",
        F.col("text").alias("content"),
        *_account("user"),
        text(item(avatar, 1), "").alias("avatar"),
        text("reply_comment_total", "0").alias("sub_comment_count"),
        F.coalesce("digg_count", F.lit(0).cast("bigint")).alias("like_count"),
        seen(as_of),
        text("reply_id", "0").alias("parent_comment_id"),
        join_list(comment_images()).alias("pictures"),
        *extra(extras, {"pictures": comment_images()}),
    )


def normalize_creator(df: DataFrame, as_of: Seen = None, extras: bool = False) -> DataFrame:
    df = opened(df, payloads.DY_CREATOR)
    zero = F.lit(0).cast("bigint")
    return df.select(
        context(df, "user_id").cast("string").alias("user_id"),
        F.col("user.nickname").alias("nickname"),
        gender("dy", "user.gender").alias("gender"),
        F.concat(
            F.lit("https://p3-pc.douyinpic.com/img/"),
            F.col("user.avatar_300x300.uri"),
            F.lit("~c5_300x300.jpeg?from=2956013662"),
        ).alias("avatar"),
        F.col("user.signature").alias("desc"),
        F.col("user.ip_location").alias("ip_location"),
        F.coalesce("user.following_count", zero).alias("follows"),
        F.coalesce("user.max_follower_count", zero).alias("fans"),
        F.coalesce("user.total_favorited", zero).alias("interaction"),
        F.coalesce("user.aweme_count", zero).alias("videos_count"),
        seen(as_of),
        *extra(extras, code=F.col("user.gender")),
    )
