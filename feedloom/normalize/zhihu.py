"""zhihu: answers, articles and videos; comments; creators from page state."""

from __future__ import annotations

from typing import Union

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.codes import gender
from feedloom.functions.nested import (
    first_map_value,
    first_match,
    first_nonzero,
    number_or_zero,
    parse_any_case,
    present,
    text_or,
)
from feedloom.functions.text import ZHIHU_ARTICLE_HOST, ZHIHU_HOST, strip_html
from feedloom.normalize import payloads
from feedloom.normalize.common import Seen, context, extra, opened, seen, text
from feedloom.operators.filters import route_by_type
from feedloom.schemas import struct
from feedloom.sources.embedded import embedded_json


def search_records(df: DataFrame) -> DataFrame:
    """Search items of a usable type with an object, as content records."""
    df = opened(df, payloads.ZHIHU_ITEM)
    usable = F.when(F.col("type").isin("search_result", "zvideo"), F.col("object"))
    keep = [c for c in df.columns if c not in ("type", "object")]
    return df.select(*keep, F.inline(present(usable)))


def author() -> Column:
    """The author, or its ``member`` when the author itself has no id."""
    fields = ("id", "url_token", "name", "avatar_url")

    def pick(name: str) -> Column:
        own, member = F.col(f"author.{name}"), F.col(f"author.member.{name}")
        return F.when(F.length("author.id") > 0, own).otherwise(member).alias(name)

    return F.struct(*[pick(name) for name in fields])


def _people(with_token: bool) -> list[Column]:
    token = F.col("_author.url_token")
    link = F.concat(F.lit(f"{ZHIHU_HOST}/people/"), token)
    columns = [
        text("_author.id", "").alias("user_id"),
        text(link, "").alias("user_link"),
        text("_author.name", "").alias("user_nickname"),
        text("_author.avatar_url", "").alias("user_avatar"),
    ]
    return columns + ([text(token, "").alias("user_url_token")] if with_token else [])


def _content(
    df: DataFrame,
    as_of: Seen,
    body: Column,
    url: Column,
    question: Column,
    desc: Column,
    created: Column,
    updated: Column,
) -> list[Column]:
    return [
        F.col("id").alias("content_id"),
        F.col("type").alias("content_type"),
        strip_html(body).alias("content_text"),
        text(url, "").alias("content_url"),
        text(question, "").alias("question_id"),
        strip_html("title").alias("title"),
        strip_html(desc).alias("desc"),
        number_or_zero(created).alias("created_time"),
        number_or_zero(updated).alias("updated_time"),
        number_or_zero("voteup_count").alias("voteup_count"),
        number_or_zero("comment_count").alias("comment_count"),
        context(df, "source_keyword").alias("source_keyword"),
        *_people(with_token=True),
        seen(as_of),
    ]


def _answer(df: DataFrame, as_of: Seen) -> list[Column]:
    question = F.col("question.id")
    url = F.concat(F.lit(f"{ZHIHU_HOST}/question/"), question, F.lit("/answer/"), F.col("id"))
    return _content(
        df, as_of, F.col("content"), url, question, text_or("description", "excerpt"),
        F.col("created_time"), F.col("updated_time"),
    )


def _article(df: DataFrame, as_of: Seen) -> list[Column]:
    return _content(
        df, as_of, F.col("content"), F.concat(F.lit(f"{ZHIHU_ARTICLE_HOST}/p/"), F.col("id")),
        F.lit(""), F.col("excerpt"), first_nonzero("created_time", "created"),
        first_nonzero("updated_time", "updated"),
    )


def _zvideo(df: DataFrame, as_of: Seen) -> list[Column]:
    """Videos come from a creator's list (``video`` is an object) or from search."""
    listed = F.coalesce(F.startswith(F.col("video"), F.lit("{")), F.lit(False))
    own_url = F.concat(F.lit(f"{ZHIHU_HOST}/zvideo/"), F.col("id"))
    return _content(
        df, as_of, F.lit(""), F.when(listed, own_url).otherwise(F.col("video_url")), F.lit(""),
        F.col("description"),
        F.when(listed, F.col("published_at")).otherwise(F.col("created_at")),
        F.when(listed, F.col("updated_at")),
    )


def normalize_content(df: DataFrame, as_of: Seen = None) -> DataFrame:
    """Answers, articles and videos, each with its own fallbacks; other types are dropped."""
    df = opened(df, payloads.ZHIHU_CONTENT).withColumn("_author", author())
    kinds = {"answer": _answer, "article": _article, "zvideo": _zvideo}
    return route_by_type(df, "type", {name: fn(df, as_of) for name, fn in kinds.items()})


def normalize_comment(df: DataFrame, as_of: Seen = None) -> DataFrame:
    """Comments of a content (``content_id`` and ``content_type`` are context columns)."""
    df = opened(df, payloads.ZHIHU_COMMENT, lambda p: p["type"] == "comment")
    location = first_match("comment_tag", lambda t: t["type"] == "ip_info")["text"]
    return df.withColumn("_author", author()).select(
        text("id", "").alias("comment_id"),
        text("reply_comment_id", "").alias("parent_comment_id"),
        strip_html("content").alias("content"),
        number_or_zero("created_time").alias("publish_time"),
        text(location, "").alias("ip_location"),
        number_or_zero("child_comment_count").alias("sub_comment_count"),
        number_or_zero("like_count").alias("like_count"),
        number_or_zero("dislike_count").alias("dislike_count"),
        text(context(df, "content_id"), "").alias("content_id"),
        text(context(df, "content_type"), "").alias("content_type"),
        *_people(with_token=False),
        seen(as_of),
    )


def page_state(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Entities of the state embedded in a page, as ``_entities``."""
    state = F.from_json(
        embedded_json(html_col, "zhihu"), payloads.ZHIHU_STATE
    )
    return df.withColumn("_entities", state["initialState"]["entities"])


def normalize_creator(
    df: DataFrame, html_col: str = "html", as_of: Seen = None, extras: bool = False
) -> DataFrame:
    """Creators from their pages; ``url_token`` names the page's owner."""
    owner = F.try_element_at("_entities.users", F.col("url_token"))
    df = page_state(df, html_col).select("url_token", F.explode(present(owner)).alias("_user"))
    counts = {
        "follows": "followingCount",
        "fans": "followerCount",
        "anwser_count": "answerCount",
        "video_count": "zvideoCount",
        "question_count": "questionCount",
        "article_count": "articlesCount",
        "column_count": "columnsCount",
        "get_voteup_count": "voteupCount",
    }
    return df.select(
        text("_user.id", "").alias("user_id"),
        F.concat(F.lit(f"{ZHIHU_HOST}/people/"), F.col("url_token")).alias("user_link"),
        text("_user.name", "").alias("user_nickname"),
        text("_user.avatarUrl", "").alias("user_avatar"),
        text_or("_user.urlToken", "url_token").alias("url_token"),
        gender("zhihu", "_user.gender").alias("gender"),
        text("_user.ipInfo", "").alias("ip_location"),
        *[number_or_zero(f"_user.{field}").alias(name) for name, field in counts.items()],
        seen(as_of),
        *extra(extras, code=F.col("_user.gender")),
    )


# The entity a kind of page holds.
PAGE_ENTITIES = {"answer": "answers", "article": "articles", "zvideo": "zvideos"}


def page_records(df: DataFrame, kind: Union[str, Column], html_col: str = "html") -> DataFrame:
    """The first record of a detail page's entity, as a payload.

    ``kind`` is one of PAGE_ENTITIES for all pages, or a column that tells each page's
    kind. Names may be in either case. An author given as a key is resolved in the
    page's users.
    """
    df = page_state(df, html_col)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    record = F.lit(None).cast("string")
    for name, entity in PAGE_ENTITIES.items():
        record = F.when(kind == name, first_map_value(f"_entities.{entity}")).otherwise(record)
    keep = [c for c in df.columns if c not in ("_entities", html_col)]
    found = df.select(*keep, "_entities.users", F.explode(present(record)).alias("_record"))
    out = parse_any_case(found, "_record", struct(payloads.ZHIHU_CONTENT), "_content")
    user = F.try_element_at("users", F.get_json_object("_record", "$.author"))
    named = F.struct(
        user["id"].alias("id"),
        user["urlToken"].alias("url_token"),
        user["name"].alias("name"),
        user["avatarUrl"].alias("avatar_url"),
        F.col("_content.author.member").alias("member"),
    )
    resolved = F.when(user.isNotNull(), named).otherwise(F.col("_content.author"))
    out = out.withColumn("_content", F.col("_content").withField("author", resolved))
    return out.select(*keep, "_content.*")
