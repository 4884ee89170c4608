"""Platform rows to the canonical content, comment and creator tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, TimestampType

from feedloom.functions.codes import gender
from feedloom.functions.times import epoch_timestamp
from feedloom.normalize.common import CODE, ITEMS
from feedloom.schemas import ACTIVITY, COMMENT, CONTACT_EDGE, CONTENT, CREATOR, struct

_ARTICLE_KEYS = {
    "title": "title",
    "body": "desc",
    "author_id": "user_id",
    "author_name": "nickname",
    "author_avatar": "avatar",
    "ip_location": "ip_location",
    "like_count": "liked_count",
    "comment_count": "comment_count",
    "share_count": "share_count",
    "collect_count": "collected_count",
}

# canonical column -> platform column
CONTENT_MAP: dict[str, dict[str, str]] = {
    "xhs": {
        **_ARTICLE_KEYS, "content_id": "note_id", "content_type": "type", "created_ts": "time",
        "updated_ts": "last_update_time", "url": "note_url", "media_urls": "video_url",
        "image_urls": "image_list", "tags": "tag_list",
    },
    "dy": {
        **_ARTICLE_KEYS, "content_id": "aweme_id", "content_type": "aweme_type",
        "created_ts": "create_time", "url": "aweme_url", "cover_url": "cover_url",
        "media_urls": "video_download_url", "image_urls": "note_download_url",
    },
    "ks": {
        "content_id": "video_id", "content_type": "video_type", "title": "title", "body": "desc",
        "created_ts": "create_time", "author_id": "user_id", "author_name": "nickname",
        "author_avatar": "avatar", "like_count": "liked_count", "view_count": "viewd_count",
        "url": "video_url", "cover_url": "video_cover_url", "media_urls": "video_play_url",
    },
    "bili": {
        "content_id": "video_id", "content_type": "video_type", "title": "title", "body": "desc",
        "created_ts": "create_time", "author_id": "user_id", "author_name": "nickname",
        "author_avatar": "avatar", "like_count": "liked_count", "comment_count": "video_comment",
        "share_count": "video_share_count", "collect_count": "video_favorite_count",
        "view_count": "video_play_count", "coin_count": "video_coin_count",
        "danmaku_count": "video_danmaku", "dislike_count": "disliked_count", "url": "video_url",
        "cover_url": "video_cover_url",
    },
    "wb": {
        "content_id": "note_id", "body": "content", "created_ts": "create_date_time",
        "author_id": "user_id", "author_name": "nickname", "author_avatar": "avatar",
        "author_url": "profile_url", "ip_location": "ip_location", "like_count": "liked_count",
        "comment_count": "comments_count", "share_count": "shared_count", "url": "note_url",
    },
    "tieba": {
        "content_id": "note_id", "title": "title", "body": "desc", "created_ts": "publish_time",
        "author_name": "user_nickname", "author_avatar": "user_avatar", "author_url": "user_link",
        "ip_location": "ip_location", "comment_count": "total_replay_num", "url": "note_url",
    },
    "zhihu": {
        "content_id": "content_id", "content_type": "content_type", "title": "title",
        "body": "content_text", "created_ts": "created_time", "updated_ts": "updated_time",
        "author_id": "user_id", "author_name": "user_nickname", "author_avatar": "user_avatar",
        "author_url": "user_link", "like_count": "voteup_count", "comment_count": "comment_count",
        "url": "content_url", "parent_id": "question_id",
    },
}

_REMARK = {
    "comment_id": "comment_id", "parent_comment_id": "parent_comment_id", "body": "content",
    "created_ts": "create_time", "author_id": "user_id", "author_name": "nickname",
    "author_avatar": "avatar", "like_count": "like_count",
    "sub_comment_count": "sub_comment_count",
}
COMMENT_MAP: dict[str, dict[str, str]] = {
    "xhs": {**_REMARK, "content_id": "note_id", "ip_location": "ip_location", "image_urls": "pictures"},
    "dy": {**_REMARK, "content_id": "aweme_id", "ip_location": "ip_location", "image_urls": "pictures"},
    "ks": {**_REMARK, "content_id": "video_id"},
    "bili": {**_REMARK, "content_id": "video_id"},
    "wb": {
        **_REMARK, "content_id": "note_id", "created_ts": "create_date_time",
        "ip_location": "ip_location", "like_count": "comment_like_count",
    },
    "tieba": {
        **_REMARK, "content_id": "note_id", "created_ts": "publish_time",
        "author_name": "user_nickname", "author_avatar": "user_avatar",
        "ip_location": "ip_location",
    },
    "zhihu": {
        **_REMARK, "content_id": "content_id", "created_ts": "publish_time",
        "author_name": "user_nickname", "author_avatar": "user_avatar",
        "ip_location": "ip_location", "dislike_count": "dislike_count",
    },
}

_PROFILE = {
    "user_id": "user_id", "name": "nickname", "gender": "gender", "avatar": "avatar",
    "bio": "desc", "ip_location": "ip_location", "follows": "follows", "fans": "fans",
    "interactions": "interaction",
}
CREATOR_MAP: dict[str, dict[str, str]] = {
    "xhs": {**_PROFILE, "tags": "tag_list"},
    "dy": {**_PROFILE, "content_count": "videos_count"},
    "ks": _PROFILE,
    "wb": _PROFILE,
    "bili": {
        "user_id": "user_id", "name": "nickname", "gender": "sex", "avatar": "avatar",
        "bio": "sign", "fans": "total_fans", "interactions": "total_liked",
    },
    "tieba": {**_PROFILE, "name": "nickname"},
    "zhihu": {
        **_PROFILE, "name": "user_nickname", "avatar": "user_avatar",
        "interactions": "get_voteup_count", "content_count": "anwser_count",
    },
}
# Edges and activity posts have their canonical names already, but for one.
ACTIVITY_MAP = {"activity_id": "dynamic_id"}

# Platform columns that hold one URL, also where the canonical column is a list.
_ONE_URL = ("video_download_url", "video_play_url")
# Platform texts that stand for "no parent".
_NO_PARENT = ("", "0")
_ROOT_IS_SELF = ("wb",)


def _as_timestamp(c: Column, source_type: str) -> Column:
    if source_type in ("bigint", "int"):
        return F.when(c > 0, epoch_timestamp(c))
    if source_type != "string":
        return c.cast("timestamp")
    zoned = F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    to_second = F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))
    to_minute = F.try_to_timestamp(c, F.lit("yyyy-M-d HH:mm"))
    epoch = F.when(c.try_cast("bigint") > 0, epoch_timestamp(c.try_cast("bigint")))
    return F.coalesce(zoned, to_second, to_minute, epoch)


def _converted(c: Column, source_type: str, target) -> Column:
    if isinstance(target, TimestampType):
        return _as_timestamp(c, source_type)
    if isinstance(target, LongType):
        return c.try_cast("bigint")
    if isinstance(target, ArrayType):
        if source_type != "string":
            return c.cast(target)
        return F.filter(F.split(c, ","), lambda x: F.length(x) > 0)
    if isinstance(target, MapType):
        return c.cast(target) if source_type != "string" else F.from_json(c, "MAP<STRING,STRING>")
    return c.cast(target)


def _mapped(
    df: DataFrame, platform: str, ddl: str, names: Mapping[str, str]
) -> DataFrame:
    """Columns without a canonical place go to ``extra``, and so do texts of counters that
    are no numbers. An array comes from the normaliser's ``_items`` column if it has one;
    a joined text is split, which cuts elements that hold a comma.
    """
    schema = struct(ddl)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    has_extra = "extra" in schema.names
    used = set(names.values()) | {"add_ts", "last_modify_ts", "source_keyword", "platform"}
    used |= {c for c in types if c.endswith(ITEMS)}
    raw = {
        names[f.name]: F.col(names[f.name])
        for f in schema.fields
        if isinstance(f.dataType, LongType) and types.get(names.get(f.name)) == "string"
    }
    raw = {c: F.when((F.length(F.trim(x)) > 0) & x.try_cast("bigint").isNull(), x) for c, x in raw.items()}
    out = []
    for f in schema.fields:
        source = names.get(f.name, f.name if f.name in used or not has_extra else None)
        if f.name == "platform":
            value = F.lit(platform)
        elif f.name == "extra":
            rest = [c for c in df.columns if c not in used]
            pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
            pairs += [x for c, value in raw.items() for x in (F.lit(c), value)]
            value = (
                F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
                if pairs
                else F.create_map().cast("map<string,string>")
            )
        elif isinstance(f.dataType, ArrayType) and f"{source}{ITEMS}" in types:
            value = F.col(f"{source}{ITEMS}").cast(f.dataType)
        elif source in types and source in _ONE_URL:
            value = F.filter(F.array(source), lambda x: F.length(x) > 0)
        elif source in types:
            value = _converted(F.col(source), types[source], f.dataType)
        else:
            value = F.lit(None).cast(f.dataType)
        out.append(value.alias(f.name))
    return df.select(*out)


def canonical_content(df: DataFrame, platform: str) -> DataFrame:
    """Counters are parsed to BIGINT (text such as ``1.2万`` gives NULL and goes to ``extra``
    under its platform name); columns without a canonical place go to ``extra``."""
    return _mapped(df, platform, CONTENT, CONTENT_MAP[platform])


def canonical_comment(df: DataFrame, platform: str) -> DataFrame:
    """Level-1 comments have a NULL parent, whatever the platform writes there."""
    out = _mapped(df, platform, COMMENT, COMMENT_MAP[platform])
    parent = F.col("parent_comment_id")
    none = parent.isin(*_NO_PARENT)
    if platform in _ROOT_IS_SELF:
        none = none | (parent == F.col("comment_id"))
    return out.withColumn("parent_comment_id", F.when(~none, parent))


#: Platforms whose tables hold the gender as the platform writes it.
_RAW_GENDER = ("bili",)


def canonical_creator(df: DataFrame, platform: str) -> DataFrame:
    """Genders are ``M`` / ``F`` / ``unknown``; where a platform table holds the platform's
    own code, or the normaliser gave it, ``extra`` has it as ``gender_code``."""
    source = CREATOR_MAP[platform]["gender"] if "gender" in CREATOR_MAP[platform] else None
    if platform in _RAW_GENDER and source in df.columns:
        df = df.withColumns({f"gender{CODE}": F.col(source), source: gender(platform, source)})
    return _mapped(df, platform, CREATOR, CREATOR_MAP[platform])


def canonical_edge(df: DataFrame, platform: str = "bili") -> DataFrame:
    return _mapped(df, platform, CONTACT_EDGE, {})


def canonical_activity(df: DataFrame, platform: str = "bili") -> DataFrame:
    return _mapped(df, platform, ACTIVITY, ACTIVITY_MAP)
