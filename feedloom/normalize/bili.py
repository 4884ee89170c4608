"""bili: videos, creators, comments, contact edges, activity posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedloom.functions.text import content_url, truncate
from feedloom.normalize import payloads
from feedloom.normalize.common import Seen, context, opened, seen, text

_COUNTERS = {
    "liked_count": "like",
    "disliked_count": "dislike",
    "video_play_count": "view",
    "video_favorite_count": "favorite",
    "video_share_count": "share",
    "video_coin_count": "coin",
    "video_danmaku": "danmaku",
    "video_comment": "reply",
}


def normalize_video(df: DataFrame, as_of: Seen = None) -> DataFrame:
    df = opened(df, payloads.BILI_VIDEO)
    return df.select(
        text("View.aid").alias("video_id"),
        F.lit("video").alias("video_type"),
        truncate(text("View.title", ""), 500).alias("title"),
        truncate(text("View.desc", ""), 500).alias("desc"),
        F.col("View.pubdate").alias("create_time"),
        text("View.owner.mid").alias("user_id"),
        F.col("View.owner.name").alias("nickname"),
        text("View.owner.face", "").alias("avatar"),
        *[text(f"View.stat.{field}", "").alias(name) for name, field in _COUNTERS.items()],
        seen(as_of),
        content_url("bili", "View.aid").alias("video_url"),
        text("View.pic", "").alias("video_cover_url"),
        context(df, "source_keyword").alias("source_keyword"),
    )


def normalize_creator(df: DataFrame, as_of: Seen = None) -> DataFrame:
    df = opened(df, payloads.BILI_VIDEO)
    return df.select(
        text("Card.card.mid").alias("user_id"),
        F.col("Card.card.name").alias("nickname"),
        F.col("Card.card.sex").alias("sex"),
        F.col("Card.card.sign").alias("sign"),
        F.col("Card.card.face").alias("avatar"),
        seen(as_of),
        F.col("Card.card.fans").alias("total_fans"),
        F.col("Card.like_num").alias("total_liked"),
        F.col("Card.card.level_info.current_level").alias("user_rank"),
        F.col("Card.card.official_verify.type").alias("is_official"),
    )


def normalize_comment(df: DataFrame, as_of: Seen = None) -> DataFrame:
    df = opened(df, payloads.BILI_COMMENT)
    return df.select(
        text("rpid").alias("comment_id"),
        text("parent", "0").alias("parent_comment_id"),
        F.col("ctime").alias("create_time"),
        context(df, "requested_id").cast("string").alias("video_id"),
        F.col("content.message").alias("content"),
        F.col("member.mid").alias("user_id"),
        F.col("member.uname").alias("nickname"),
        F.col("member.sex").alias("sex"),
        F.col("member.sign").alias("sign"),
        F.col("member.avatar").alias("avatar"),
        text("rcount", "0").alias("sub_comment_count"),
        F.coalesce("like", F.lit(0).cast("bigint")).alias("like_count"),
        seen(as_of),
    )


def _edges(df: DataFrame, up: str, fan: str, as_of: Seen) -> DataFrame:
    fields = (("id", "mid"), ("name", "uname"), ("sign", "sign"), ("avatar", "face"))

    def side(role: str, source: str):
        for name, payload_field in fields:
            c = f"creator_{name}" if source == "creator" else payload_field
            yield F.col(c).cast("string").alias(f"{role}_{name}")

    return df.select(*side("up", up), *side("fan", fan), seen(as_of))


def normalize_fans(df: DataFrame, as_of: Seen = None) -> DataFrame:
    """Fan rows of a creator (``creator_id/_name/_sign/_avatar`` are context columns)."""
    return _edges(opened(df, payloads.BILI_CONTACT), "creator", "contact", as_of)


def normalize_followings(df: DataFrame, as_of: Seen = None) -> DataFrame:
    """Following rows: the followed account is the upper end of the edge."""
    return _edges(opened(df, payloads.BILI_CONTACT), "contact", "creator", as_of)


def normalize_activity(df: DataFrame, as_of: Seen = None) -> DataFrame:
    df = opened(df, payloads.BILI_DYNAMIC)
    stat = "modules.module_stat"
    return df.select(
        F.col("id_str").alias("dynamic_id"),
        context(df, "creator_id").cast("string").alias("user_id"),
        context(df, "creator_name").alias("user_name"),
        text("modules.module_dynamic.desc.text", "").alias("text"),
        F.substring_index("type", "_", -1).alias("type"),
        F.col("modules.module_author.pub_ts").alias("pub_ts"),
        F.col(f"{stat}.comment.count").alias("total_comments"),
        F.col(f"{stat}.forward.count").alias("total_forwards"),
        F.col(f"{stat}.like.count").alias("total_liked"),
        seen(as_of),
    )
