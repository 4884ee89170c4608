"""String functions (HTML to text, counts, URLs, key=value texts)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from feedloom.functions.nested import ColumnOrName, col

# URL templates of the platforms ({} is the natural id).
CONTENT_URL = {
    "xhs": "https://www.xiaohongshu.com/explore/{}",
    "bili": "https://www.bilibili.com/video/av{}",
    "dy": "https://www.douyin.com/video/{}",
    "ks": "https://www.kuaishou.com/short-video/{}",
    "wb": "https://m.weibo.cn/detail/{}",
    "tieba": "https://tieba.baidu.com/p/{}",
}
TIEBA_HOST = "https://tieba.baidu.com"
ZHIHU_HOST = "https://www.zhihu.com"
ZHIHU_ARTICLE_HOST = "https://zhuanlan.zhihu.com"

# Image hosts and the query that selects a format.
IMAGE_HOSTS = [
    "https://sns-img-qc.xhscdn.com",
    "https://sns-img-hw.xhscdn.com",
    "https://sns-img-bd.xhscdn.com",
    "https://sns-img-qn.xhscdn.com",
]
VIDEO_HOST = "http://sns-video-bd.xhscdn.com"

# Unicode white space plus the four separators Python also strips. The look-behind
# tries a run of blanks once, at its start, so long runs cost linear time.
_BLANK = r"[\s\x1c-\x1f]"
_EDGE_BLANKS = rf"(?U)\A{_BLANK}+|(?<!{_BLANK}){_BLANK}++\z"

# A tag, or an opener that is never closed, which is kept ($1). Without the second
# half every such opener would be followed to the end of the text.
_TAG = r"<[^>]++>|(<[^>]*+\z)"
_TAG_ON_A_LINE = r"<[^>\n]*+>|(<[^>\n]*+)"


def strip(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), _EDGE_BLANKS, "")


# Stands where an element was, so that what adjoined it is not read as a tag.
_GONE = "\ue000\uf8ff\ue000"


def _without_code(c: Column) -> Column:
    """Script and style elements removed, each from its opener to the next closer.

    An opener that never closes takes the rest of the text with it and gives it back ($1),
    so the rest is searched for a closer once. Only elements of the other tag can stand in
    that rest, and a search for each tag alone finds them. Every search is linear.
    """
    for tags in (("script", "style"), ("script",), ("style",)):
        whole = "|".join(f"<{tag}[^>]*+>.*?</{tag}>" for tag in tags)
        c = F.regexp_replace(c, f"(?s){whole}|(<(?:{'|'.join(tags)}).*+)", f"{_GONE}$1")
    return F.replace(c, F.lit(_GONE), F.lit(""))


def strip_html(c: ColumnOrName) -> Column:
    """Text of an HTML fragment: no script/style bodies, no tags, trimmed; '' for NULL."""
    no_code = _without_code(F.coalesce(col(c), F.lit("")))
    return strip(F.regexp_replace(no_code, _TAG, "$1"))


def strip_tags_short(c: ColumnOrName) -> Column:
    """Remove ``<...>`` runs that stay on one line; nothing else is touched."""
    return F.regexp_replace(col(c), _TAG_ON_A_LINE, "$1")


def truncate(c: ColumnOrName, n: int) -> Column:
    return F.substring(col(c), 1, n)


def first_int(c: ColumnOrName) -> Column:
    """First run of digits as BIGINT, 0 without one. ``1.2万`` gives 1."""
    digits = F.regexp_extract(col(c).cast("string"), "[0-9]+", 0)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def drop_text(c: ColumnOrName, *parts: str) -> Column:
    out = col(c)
    for part in parts:
        out = F.replace(out, F.lit(part), F.lit(""))
    return out


def strip_location(c: ColumnOrName) -> Column:
    """Location without the 'published in' / 'from' prefixes."""
    return drop_text(c, "发布于 ", "来自")


# --- URLs -----------------------------------------------------------------


def url_path(c: ColumnOrName) -> Column:
    """The part before query and fragment."""
    return F.substring_index(F.substring_index(col(c), "#", 1), "?", 1)


def last_segment(c: ColumnOrName) -> Column:
    return F.substring_index(F.substring_index(col(c), "?", 1), "/", -1)


def segment_from_end(c: ColumnOrName, n: int) -> Column:
    """The n-th path segment counted from the end (1 = last), NULL if there is none."""
    return F.try_element_at(F.split(F.substring_index(col(c), "?", 1), "/"), F.lit(-n))


def url_kind(c: ColumnOrName) -> Column:
    u = col(c)
    return (
        F.when(F.contains(u, F.lit("/answer/")), "answer")
        .when(F.contains(u, F.lit("/p/")), "article")
        .when(F.contains(u, F.lit("/zvideo/")), "zvideo")
        .otherwise("")
    )


def _decode_param(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def query_string(c: ColumnOrName) -> Column:
    return F.regexp_extract(col(c), r"^[^?#]*\?([^#]*)", 1)


def query_to_map(query: ColumnOrName) -> Column:
    """``a=1&b=2`` as a decoded map; empty values dropped, the last key wins."""
    pairs = F.transform(
        F.split(col(query), "&"),
        lambda p: F.struct(
            _decode_param(F.substring_index(p, "=", 1)).alias("key"),
            F.when(
                F.contains(p, F.lit("=")),
                _decode_param(F.regexp_replace(p, r"(?s)^[^=]*=", "")),
            ).alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(pairs, lambda p: F.length(p["value"]) > 0))


def url_params(c: ColumnOrName) -> Column:
    return query_to_map(query_string(F.coalesce(col(c), F.lit(""))))


def note_ref(c: ColumnOrName) -> Column:
    """Note URL as ``struct(note_id, xsec_token, xsec_source)``."""
    params = url_params(c)
    return F.struct(
        last_segment(c).alias("note_id"),
        F.coalesce(F.try_element_at(params, F.lit("xsec_token")), F.lit("")).alias("xsec_token"),
        F.coalesce(F.try_element_at(params, F.lit("xsec_source")), F.lit("")).alias("xsec_source"),
    )


def content_url(platform: str, content_id: ColumnOrName) -> Column:
    head, tail = CONTENT_URL[platform].split("{}")
    return F.concat(F.lit(head), col(content_id).cast("string"), F.lit(tail))


def trace_id(c: ColumnOrName) -> Column:
    """Asset id of an image URL; the ``spectrum/`` folder is kept."""
    last = F.substring_index(col(c), "/", -1)
    return F.when(
        F.contains(col(c), F.lit("spectrum")), F.concat(F.lit("spectrum/"), last)
    ).otherwise(last)


def image_urls(asset: ColumnOrName, image_format: str = "png") -> Column:
    """URL of one asset on each image host."""
    tail = f"?imageView2/format/{image_format}"
    return F.array(*[F.concat(F.lit(f"{host}/"), col(asset), F.lit(tail)) for host in IMAGE_HOSTS])


# --- key=value texts ------------------------------------------------------


def kv_to_map(c: ColumnOrName) -> Column:
    """``"a=1; b=2"`` as a map; parts without exactly one '=' are dropped."""
    parts = F.transform(
        F.split(F.coalesce(col(c), F.lit("")), ";"), lambda p: F.split(strip(p), "=")
    )
    pairs = F.transform(
        F.filter(parts, lambda p: F.size(p) == 2),
        lambda p: F.struct(p[0].alias("key"), p[1].alias("value")),
    )
    return F.map_from_entries(pairs)


def map_to_kv(c: ColumnOrName) -> Column:
    entries = F.map_entries(col(c))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    )


# --- fields written into page text ---------------------------------------


def page_location(c: ColumnOrName) -> Column:
    # Reluctant: the value ends with its own element even when the next one adjoins.
    return F.regexp_extract(col(c), r"IP属地:(\S+?)</span>", 1)


def page_time(c: ColumnOrName) -> Column:
    return F.regexp_extract(
        col(c), r'<span class="tail-info">(\d{4}-\d{2}-\d{2} \d{2}:\d{2})</span>', 1
    )


def page_site_age(c: ColumnOrName) -> Column:
    return F.regexp_extract(col(c), r"<span>吧龄:(\S+?)</span>", 1)


def page_relation_count(c: ColumnOrName) -> Column:
    number = F.regexp_extract(
        col(c), r'<span class="concern_num">\(<a[^>]*>(\d+)</a>\)</span>', 1
    )
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))


def page_gender(c: ColumnOrName) -> Column:
    return (
        F.when(F.contains(col(c), F.lit("sex_male")), "M")
        .when(F.contains(col(c), F.lit("sex_female")), "F")
        .otherwise("unknown")
    )


def drop_title_suffix(title: ColumnOrName, forum: ColumnOrName) -> Column:
    suffix = F.concat(F.lit("【"), col(forum), F.lit("】_百度贴吧"))
    return F.replace(col(title), suffix, F.lit(""))


def open_comments(c: ColumnOrName) -> Column:
    """Drop comment openers so that markup hidden in comments becomes visible."""
    return drop_text(c, "<!--")


# --- JSON repair ----------------------------------------------------------


def repair_undefined(c: ColumnOrName, all_as_text: bool) -> Column:
    """JavaScript ``undefined`` to ``""`` where a value stands, or after a colon to ``null``."""
    if all_as_text:
        return F.regexp_replace(col(c), r"(?<=[:,\[])undefined(?=[,}\]])", '""')
    return F.replace(col(c), F.lit(":undefined"), F.lit(":null"))


def html_unescape(c: ColumnOrName) -> Column:
    """Decode HTML entities (Arrow batches; Spark has no built-in for it)."""

    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decode, StringType())(col(c))


# --- tokens ---------------------------------------------------------------

_HAN = r"\p{IsHan}"


# A letter or digit that is not a Han character; plain ASCII is tested first.
_WORD = rf"[a-zA-Z0-9[\p{{L}}\p{{N}}&&[^{_HAN}]]]"


def _custom_pattern(word: str) -> str:
    """One custom word; its alphabetic ends must not continue into a longer word."""
    def alphabetic(ch: str) -> bool:
        return ch.isalnum() and not "\u2e80" <= ch

    head = f"(?<!{_WORD})" if alphabetic(word[0]) else ""
    tail = f"(?!{_WORD})" if alphabetic(word[-1]) else ""
    return head + re.escape(word) + tail


def tokens(c: ColumnOrName, custom: Iterable[str] = (), han: str = "char") -> Column:
    """Tokens of a text in order. Han runs become characters or bigrams.

    A custom word inside a Han run wins over the run: Han characters are then
    matched one at a time so that every position may start a custom word.
    """
    if han not in ("char", "bigram"):
        raise ValueError(f"unknown Han mode {han!r}")
    custom = [w for w in custom if w]
    text = col(c)
    if not custom and han == "char":
        pattern = f"{_WORD}+|{_HAN}"
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    longest_first = sorted(custom, key=lambda w: (-len(w), w))
    guard = "|".join(_custom_pattern(w) for w in longest_first)
    run = f"(?:(?!{guard}){_HAN})++" if guard else f"{_HAN}++"
    pattern = "|".join(p for p in (guard, f"{_WORD}+", run) if p)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def split_run(w: Column) -> Column:
        if han == "char":
            pieces = F.regexp_extract_all(w, F.lit(_HAN), F.lit(0))
        else:
            starts = F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1)))
            pieces = F.transform(starts, lambda i: F.substring(w, i, F.lit(2)))
        is_run = F.rlike(w, F.lit(f"^{_HAN}+$"))
        if custom:
            is_run = is_run & ~w.isin(*custom)
        return F.when(is_run, pieces).otherwise(F.array(w))

    return F.flatten(F.transform(found, split_run))

