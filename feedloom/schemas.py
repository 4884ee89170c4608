"""Canonical tables, per-platform table names with their natural keys."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql.types import StructType

# One table per role, partitioned by platform. Kept as DDL: it is parsed by Spark,
# so only once there is a session.
CONTENT = """platform STRING, content_id STRING, content_type STRING, title STRING, body STRING,
    created_ts TIMESTAMP, updated_ts TIMESTAMP, author_id STRING, author_name STRING,
    author_avatar STRING, author_url STRING, ip_location STRING, like_count BIGINT,
    comment_count BIGINT, share_count BIGINT, collect_count BIGINT, view_count BIGINT,
    coin_count BIGINT, danmaku_count BIGINT, dislike_count BIGINT, url STRING,
    cover_url STRING, media_urls ARRAY<STRING>, image_urls ARRAY<STRING>,
    tags ARRAY<STRING>, parent_id STRING, source_keyword STRING, add_ts BIGINT,
    last_modify_ts BIGINT, extra MAP<STRING,STRING>"""
COMMENT = """platform STRING, comment_id STRING, parent_comment_id STRING, content_id STRING,
    body STRING, created_ts TIMESTAMP, author_id STRING, author_name STRING,
    author_avatar STRING, ip_location STRING, like_count BIGINT, dislike_count BIGINT,
    sub_comment_count BIGINT, image_urls ARRAY<STRING>, add_ts BIGINT,
    last_modify_ts BIGINT, extra MAP<STRING,STRING>"""
CREATOR = """platform STRING, user_id STRING, name STRING, gender STRING, avatar STRING,
    bio STRING, ip_location STRING, follows BIGINT, fans BIGINT, interactions BIGINT,
    content_count BIGINT, tags MAP<STRING,STRING>, add_ts BIGINT, last_modify_ts BIGINT,
    extra MAP<STRING,STRING>"""
CONTACT_EDGE = """platform STRING, up_id STRING, fan_id STRING, up_name STRING, fan_name STRING,
    up_sign STRING, fan_sign STRING, up_avatar STRING, fan_avatar STRING, add_ts BIGINT,
    last_modify_ts BIGINT"""
ACTIVITY = """platform STRING, activity_id STRING, user_id STRING, user_name STRING, text STRING,
    type STRING, pub_ts TIMESTAMP, total_comments BIGINT, total_forwards BIGINT,
    total_liked BIGINT, add_ts BIGINT, last_modify_ts BIGINT"""


@lru_cache(maxsize=None)
def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


CANONICAL = {
    "content": (CONTENT, ("platform", "content_id")),
    "comment": (COMMENT, ("platform", "comment_id")),
    "creator": (CREATOR, ("platform", "user_id")),
    "contact_edge": (CONTACT_EDGE, ("platform", "up_id", "fan_id")),
    "activity": (ACTIVITY, ("platform", "activity_id")),
}

# Platform tables and their natural keys.
NATURAL_KEYS = {
    "bilibili_video": ("video_id",),
    "bilibili_video_comment": ("comment_id",),
    "bilibili_up_info": ("user_id",),
    "bilibili_contact_info": ("up_id", "fan_id"),
    "bilibili_up_dynamic": ("dynamic_id",),
    "douyin_aweme": ("aweme_id",),
    "douyin_aweme_comment": ("comment_id",),
    "dy_creator": ("user_id",),
    "kuaishou_video": ("video_id",),
    "kuaishou_video_comment": ("comment_id",),
    "weibo_note": ("note_id",),
    "weibo_note_comment": ("comment_id",),
    "weibo_creator": ("user_id",),
    "xhs_creator": ("user_id",),
    "xhs_note": ("note_id",),
    "xhs_note_comment": ("comment_id",),
    "tieba_note": ("note_id",),
    "tieba_comment": ("comment_id",),
    "tieba_creator": ("user_id",),
    "zhihu_content": ("content_id",),
    "zhihu_comment": ("comment_id",),
    "zhihu_creator": ("user_id",),
}
