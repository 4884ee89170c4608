"""tieba: threads from three page shapes, two comment levels, creators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.nested import number_or_zero, present, text_or
from feedloom.functions.text import (
    TIEBA_HOST,
    content_url,
    drop_title_suffix,
    last_segment,
    open_comments,
    page_gender,
    page_location,
    page_relation_count,
    page_site_age,
    page_time,
    query_to_map,
    strip,
    strip_html,
)
from feedloom.normalize import payloads
from feedloom.normalize.common import Seen, context, seen, text
from feedloom.sources.pages import PageSpec, Take, at, parse_html

# Where the pages keep their fields. Class texts are exact, with
# the trailing blanks the pages have.
_TITLE_LINK = (at("span", cls="p_title"), at("a", child=True))
_FORUM_LINK = (at("a", cls="p_forum"),)
_HOME_LINK = (at("a", href_prefix="/home/main"),)
_CARD = (at("a", cls="card_title_fname"),)
_FACE = (at("a", cls="p_author_face "),)
_AUTHOR = (at("a", cls="p_author_name j_user_card"),)
_TAIL = (at("div", cls="post-tail-wrap"),)
_REPLY_COUNTS = (at("div", id="thread_theme_5"), at("li", cls="l_reply_num"), at("span", cls="red"))
_USER_DATA = (at("div", cls="userinfo_userdata"),)
_RELATIONS = (at("span", cls="concern_num"),)

SEARCH_PAGE = PageSpec(
    blocks=((at("div", cls="s_post"),),),
    fields={
        "note_id": Take(_TITLE_LINK, "data-tid"),
        "title": Take(_TITLE_LINK),
        "desc": Take((at("div", cls="p_content"),)),
        "href": Take(_TITLE_LINK, "href"),
        "user_nickname": Take((*_HOME_LINK, at("font", child=True))),
        "user_href": Take(_HOME_LINK, "href"),
        "tieba_name": Take((*_FORUM_LINK, at("font", child=True))),
        "tieba_href": Take(_FORUM_LINK, "href"),
        "publish_time": Take((at("font", cls="p_green p_date"),)),
    },
)
FORUM_PAGE = PageSpec(
    blocks=((at("ul", id="thread_list"), at("li", child=True)),),
    fields={
        "data_field": Take((), "data-field", unescape=True),
        "title": Take((at("a", cls="j_th_tit "),)),
        "desc": Take((at("div", cls="threadlist_abs threadlist_abs_onlyline "),)),
        "user_href": Take((at("a", cls="frs-author-name j_user_card "),), "href"),
        "tieba_name": Take(_CARD, whole_page=True),
        "tieba_href": Take(_CARD, "href", whole_page=True),
    },
)
_FIRST_POSTS = at("div", cls="p_postlist", nth=1)
DETAIL_PAGE = PageSpec(
    blocks=((),),
    fields={
        "author_only_href": Take((at(id="lzonly_cntn"),), "href"),
        "title": Take((at("title"),)),
        "desc": Take((at("meta", name="description"),), "content"),
        "user_href": Take((_FIRST_POSTS, *_FACE), "href"),
        "user_nickname": Take((_FIRST_POSTS, *_AUTHOR)),
        "user_avatar": Take((_FIRST_POSTS, *_FACE, at("img", child=True)), "src"),
        "tieba_name": Take(_CARD),
        "tieba_href": Take(_CARD, "href"),
        "tail": Take(_TAIL, "html"),
        "reply_num": Take(_REPLY_COUNTS),
        "reply_pages": Take(_REPLY_COUNTS, index=1),
    },
)
POSTS_PAGE = PageSpec(
    blocks=((at("div", cls="l_post l_post_bright j_l_post clearfix  "),),),
    fields={
        "data_field": Take((), "data-field", unescape=True),
        "user_href": Take(_FACE, "href"),
        "user_nickname": Take(_AUTHOR),
        "user_avatar": Take((*_FACE, at("img", child=True)), "src"),
        "tieba_name": Take(_CARD, whole_page=True),
        "tail": Take(_TAIL, "html"),
    },
)
_REPLY_CARD = (at("a", child=True, cls="j_user_card lzl_p_p"),)
REPLIES_PAGE = PageSpec(
    blocks=(
        (at("li", cls="lzl_single_post j_lzl_s_p first_no_border"),),
        (at("li", cls="lzl_single_post j_lzl_s_p "),),
    ),
    fields={
        "data_field": Take((), "data-field", unescape=True),
        "body": Take((at("span", cls="lzl_content_main"),), "html"),
        "user_href": Take(_REPLY_CARD, "href"),
        "user_avatar": Take((*_REPLY_CARD, at("img", child=True)), "src"),
        "publish_time": Take((at("span", cls="lzl_time"),)),
    },
)
CREATOR_PAGE = PageSpec(
    blocks=((),),
    fields={
        "space_href": Take((at("p", cls="space"), at("a", child=True)), "href"),
        "nickname": Take((at("span", cls="userinfo_username "),)),
        "avatar": Take((at("div", cls="userinfo_left_head"), at("img")), "src"),
        "user_data": Take(_USER_DATA, "html"),
        "follows": Take(_RELATIONS, "html"),
        "fans": Take(_RELATIONS, "html", index=1),
        "third_relation": Take(_RELATIONS, "html", index=2),
    },
)
CREATOR_THREADS = PageSpec(
    blocks=(
        (
            at("ul", cls="new_list clearfix"),
            at("div", cls="thread_name"),
            at("a", child=True, nth=1),
        ),
    ),
    fields={"href": Take((), "href")},
)


def _host(href: str) -> Column:
    return F.concat(F.lit(TIEBA_HOST), F.col(href))


def _field_json(df: DataFrame, ddl: str) -> DataFrame:
    """Parse the JSON of ``data_field``; blocks without readable JSON are dropped."""
    raw = strip("data_field")
    readable = (F.length(raw) > 0) & (raw != "{}") & F.try_parse_json(raw).isNotNull()
    return df.select(
        *[c for c in df.columns if c != "data_field"],
        F.explode(present(F.when(readable, F.from_json(raw, ddl)))).alias("_f"),
    )


def _thread(df: DataFrame, as_of: Seen, **columns: Column) -> DataFrame:
    """The thread model; fields a page shape lacks take their defaults."""
    names = (
        "note_id", "title", "desc", "note_url", "publish_time", "user_link", "user_nickname",
        "user_avatar", "tieba_name", "tieba_link",
    )
    zero = F.lit(0).cast("bigint")
    return df.select(
        *[text(columns.get(n, F.lit("")), "").alias(n) for n in names],
        F.coalesce(columns.get("total_replay_num", zero), zero).alias("total_replay_num"),
        F.coalesce(columns.get("total_replay_page", zero), zero).alias("total_replay_page"),
        text(columns.get("ip_location", F.lit("")), "").alias("ip_location"),
        text(context(df, "source_keyword"), "").alias("source_keyword"),
        seen(as_of),
    )


def normalize_search(pages: DataFrame, html_col: str = "html", as_of: Seen = None) -> DataFrame:
    """Threads of search result pages."""
    df = parse_html(pages, SEARCH_PAGE, html_col)
    plain = {
        n: strip(n)
        for n in ("note_id", "title", "desc", "user_nickname", "tieba_name", "publish_time")
    }
    return _thread(
        df, as_of, note_url=_host("href"), user_link=_host("user_href"),
        tieba_link=_host("tieba_href"), **plain,
    )


def normalize_forum(pages: DataFrame, html_col: str = "html", as_of: Seen = None) -> DataFrame:
    """Threads of forum pages, whose list is hidden in comments."""
    opened = pages.withColumn(html_col, open_comments(html_col))
    df = _field_json(parse_html(opened, FORUM_PAGE, html_col), payloads.TIEBA_THREAD_FIELD)
    return _thread(
        df, as_of,
        note_id=F.col("_f.id"),
        title=strip("title"),
        desc=strip("desc"),
        note_url=content_url("tieba", "_f.id"),
        user_link=F.concat(F.lit(TIEBA_HOST), strip("user_href")),
        user_nickname=text_or("_f.authoer_nickname", "_f.author_name"),
        tieba_name=strip("tieba_name"),
        tieba_link=_host("tieba_href"),
        total_replay_num=F.col("_f.reply_num"),
    )


def normalize_detail(pages: DataFrame, html_col: str = "html", as_of: Seen = None) -> DataFrame:
    """The thread of a detail page."""
    df = parse_html(pages, DETAIL_PAGE, html_col)
    note_id = last_segment(strip("author_only_href"))
    forum = strip("tieba_name")
    return _thread(
        df, as_of,
        note_id=note_id,
        title=drop_title_suffix(strip("title"), forum),
        desc=strip("desc"),
        note_url=content_url("tieba", note_id),
        publish_time=page_time("tail"),
        user_link=F.concat(F.lit(TIEBA_HOST), strip("user_href")),
        user_nickname=strip("user_nickname"),
        user_avatar=strip("user_avatar"),
        tieba_name=forum,
        tieba_link=_host("tieba_href"),
        total_replay_num=number_or_zero(strip("reply_num")),
        total_replay_page=number_or_zero(strip("reply_pages")),
        ip_location=page_location("tail"),
    )


def normalize_comment(pages: DataFrame, html_col: str = "html", as_of: Seen = None) -> DataFrame:
    """Level-1 comments; ``note_id`` (the thread of the page) is a context column."""
    df = _field_json(parse_html(pages, POSTS_PAGE, html_col), payloads.TIEBA_POST_FIELD)
    forum = strip("tieba_name")
    return df.select(
        F.col("_f.content.post_id").alias("comment_id"),
        F.lit("").alias("parent_comment_id"),
        strip_html("_f.content.content").alias("content"),
        F.concat(F.lit(TIEBA_HOST), strip("user_href")).alias("user_link"),
        strip("user_nickname").alias("user_nickname"),
        strip("user_avatar").alias("user_avatar"),
        page_time("tail").alias("publish_time"),
        page_location("tail").alias("ip_location"),
        number_or_zero("_f.content.comment_num").alias("sub_comment_count"),
        text("note_id").alias("note_id"),
        content_url("tieba", "note_id").alias("note_url"),
        text("_f.content.forum_id", "").alias("tieba_id"),
        forum.alias("tieba_name"),
        F.concat(F.lit(f"{TIEBA_HOST}/f?kw="), forum).alias("tieba_link"),
        seen(as_of),
    )


INHERITED = ("note_id", "note_url", "tieba_id", "tieba_name", "tieba_link")


def normalize_reply(pages: DataFrame, html_col: str = "html", as_of: Seen = None) -> DataFrame:
    """Level-2 comments. Each page row carries its parent's id (``parent_comment_id``)
    and the inherited columns (see ``INHERITED``)."""
    df = _field_json(parse_html(pages, REPLIES_PAGE, html_col), payloads.TIEBA_REPLY_FIELD)
    return df.select(
        F.col("_f.spid").alias("comment_id"),
        "parent_comment_id",
        strip_html("body").alias("content"),
        F.col("user_href").alias("user_link"),
        text("_f.showname", "").alias("user_nickname"),
        "user_avatar",
        strip("publish_time").alias("publish_time"),
        F.lit("").alias("ip_location"),
        F.lit(0).cast("bigint").alias("sub_comment_count"),
        *INHERITED,
        seen(as_of),
    )


def normalize_creator(pages: DataFrame, html_col: str = "html", as_of: Seen = None) -> DataFrame:
    df = parse_html(pages, CREATOR_PAGE, html_col)
    query = F.try_url_decode(F.substring_index("space_href", "?", -1))
    params = query_to_map(F.coalesce(query, F.substring_index("space_href", "?", -1)))
    # Exactly two relation nodes name follows and fans; any other number is unknown.
    pair = (F.length("fans") > 0) & (F.length("third_relation") == 0)

    def relation(name: str) -> Column:
        return F.when(pair, page_relation_count(name)).otherwise(0).cast("bigint")

    return df.select(
        text(F.try_element_at(params, F.lit("id")), "").alias("user_id"),
        text(F.try_element_at(params, F.lit("un")), "").alias("user_name"),
        strip("nickname").alias("nickname"),
        page_gender("user_data").alias("gender"),
        strip("avatar").alias("avatar"),
        page_location("user_data").alias("ip_location"),
        relation("follows").alias("follows"),
        relation("fans").alias("fans"),
        page_site_age("user_data").alias("registration_duration"),
        seen(as_of),
    )


def creator_threads(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Ids of the threads listed on creator pages, in page order."""
    df = parse_html(pages, CREATOR_THREADS, html_col)
    keep = [c for c in pages.columns if c != html_col]
    return df.select(*keep, "record_pos", last_segment("href").alias("note_id"))
