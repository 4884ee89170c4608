"""Detail flow: seed URLs to the records embedded in their landed pages."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Optional, Union

from pyspark.sql import DataFrame, functions as F

from feedloom.functions.text import last_segment, url_kind
from feedloom.normalize import xhs, zhihu
from feedloom.operators.joins import prefer
from feedloom.plans.comments import KEYS, Discussion, discussion


@dataclass(frozen=True)
class DetailResult:
    content: DataFrame
    not_found: DataFrame
    discussion: Optional[Discussion] = None


def detail_run(
    seeds: DataFrame,
    content: DataFrame,
    comment: Optional[DataFrame] = None,
    comments_per_content: int = 10,
    replies: bool = False,
    stop: Union[Iterable[str], DataFrame] = (),
) -> DetailResult:
    """The contents that ``seeds(platform, content_id)`` name, of any platform, the seeds
    without one, and with ``comment`` the comments and words of those found.

    ``content`` and ``comment`` are canonical: each platform's normaliser makes them.
    """
    wanted = seeds.select(*KEYS).distinct()
    found = content.join(wanted, KEYS, "left_semi")
    lost = wanted.join(found.select(*KEYS).distinct(), KEYS, "left_anti")
    said = None
    if comment is not None:
        said = discussion(found, comment, comments_per_content, replies=replies, stop=stop)
    return DetailResult(found, lost, said)


def xhs_details(api: DataFrame, pages: DataFrame) -> DataFrame:
    """Notes by id: the response's record, with gaps and lost notes filled from the page.

    ``api`` holds note payloads; ``pages(note_id, html)`` the landed detail pages.
    """
    return prefer(xhs.normalize_note(api), xhs.normalize_note(xhs.page_notes(pages)), ["note_id"])


def zhihu_details(seeds: DataFrame, pages: DataFrame) -> DetailResult:
    """``seeds(url)`` and ``pages(url, html)``: contents found, and seeds without a page.

    Both sides are matched by (kind, id) of their URL, so query strings do not matter.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"kind": url_kind("url"), "id_in_url": last_segment("url")})

    keys = ["kind", "id_in_url"]
    wanted, landed = keyed(seeds).select(*keys, "url"), keyed(pages).select(*keys, "html")
    hits = landed.join(wanted.select(*keys).distinct(), keys, "left_semi")
    content = zhihu.normalize_content(zhihu.page_records(hits, F.col("kind")))
    lost = wanted.join(landed.select(*keys), keys, "left_anti").select("url")
    return DetailResult(content, lost)


