"""Code lists and the columns or intervals they select."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, functions as F

from feedloom.functions.nested import ColumnOrName, col

PLATFORMS = ("xhs", "dy", "ks", "bili", "wb", "tieba", "zhihu")

# Gender codes per platform. None is "any other code".
GENDER_CODES = {
    "xhs": {"1": "F", "0": "M", None: None},
    "zhihu": {"1": "M", "0": "F", None: "unknown"},
    "dy": {"0": "unknown", "1": "M", "2": "F", None: "unknown"},
    "ks": {"F": "F", None: "M"},
    "wb": {"f": "F", None: "M"},
    "bili": {"男": "M", "女": "F", None: "unknown"},
}


def gender(platform: str, code: ColumnOrName) -> Column:
    """Platform gender code to ``M`` / ``F`` / ``unknown``."""
    codes = GENDER_CODES[platform]
    text = col(code).cast("string")
    out = F.lit(None).cast("string")
    first = True
    for raw, label in codes.items():
        if raw is None:
            continue
        out = F.when(text == raw, label) if first else out.when(text == raw, label)
        first = False
    return out.otherwise(F.lit(codes[None]).cast("string"))


# Contents on one page of a platform's search.
PAGE_SIZES = {"xhs": 20, "bili": 20, "ks": 20, "zhihu": 20, "dy": 10, "wb": 10, "tieba": 10}

# Whether replies use up a content's comment cap; None is "no cap".
REPLIES_COUNT = {
    "xhs": True,
    "wb": True,
    "ks": True,
    "dy": True,
    "tieba": False,
    "bili": False,
    "zhihu": None,
}


class ContentOrder(Enum):
    """Named orders of a content list."""

    GENERAL = "general"
    RELEVANCE = "relevance"
    MOST_LIKED = "most_liked"
    LATEST = "latest"
    OLDEST = "oldest"
    MOST_CLICKED = "most_clicked"
    MOST_DANMAKU = "most_danmaku"
    MOST_COLLECTED = "most_collected"


class CommentOrder(Enum):
    HEAT = "heat"
    HEAT_THEN_TIME = "heat_then_time"
    TIME = "time"


# The platforms' own sort codes and the order each one names.
SORT_CODES = {
    ("xhs", "general"): ContentOrder.GENERAL,
    ("xhs", "popularity_descending"): ContentOrder.MOST_LIKED,
    ("xhs", "time_descending"): ContentOrder.LATEST,
    ("dy", "0"): ContentOrder.GENERAL,
    ("dy", "1"): ContentOrder.MOST_LIKED,
    ("dy", "2"): ContentOrder.LATEST,
    ("bili", ""): ContentOrder.GENERAL,
    ("bili", "click"): ContentOrder.MOST_CLICKED,
    ("bili", "pubdate"): ContentOrder.LATEST,
    ("bili", "dm"): ContentOrder.MOST_DANMAKU,
    ("bili", "stow"): ContentOrder.MOST_COLLECTED,
    ("tieba", "1"): ContentOrder.LATEST,
    ("tieba", "0"): ContentOrder.OLDEST,
    ("tieba", "2"): ContentOrder.RELEVANCE,
    ("zhihu", ""): ContentOrder.GENERAL,
    ("zhihu", "upvoted_count"): ContentOrder.MOST_LIKED,
    ("zhihu", "created_time"): ContentOrder.LATEST,
}

# Publish-time windows as (months, days); None is "no limit".
PUBLISH_WINDOWS = {
    "unlimited": None,
    "one_day": (0, 1),
    "one_week": (0, 7),
    "one_month": (1, 0),
    "three_months": (3, 0),
    "half_year": (6, 0),
    "one_year": (12, 0),
    "180_days": (0, 180),
}

# The platforms' own codes of those windows.
WINDOW_CODES = {
    ("dy", "0"): "unlimited",
    ("dy", "1"): "one_day",
    ("dy", "7"): "one_week",
    ("dy", "180"): "180_days",
    ("zhihu", ""): "unlimited",
    ("zhihu", "a_day"): "one_day",
    ("zhihu", "a_week"): "one_week",
    ("zhihu", "a_month"): "one_month",
    ("zhihu", "three_months"): "three_months",
    ("zhihu", "half_a_year"): "half_year",
    ("zhihu", "a_year"): "one_year",
}

# Kind filters per platform; None keeps every kind.
KIND_CODES = {
    ("xhs", "0"): None,
    ("xhs", "1"): ("video",),
    ("xhs", "2"): ("normal",),
    ("zhihu", ""): None,
    ("zhihu", "answer"): ("answer",),
    ("zhihu", "article"): ("article",),
    ("zhihu", "zvideo"): ("zvideo",),
    ("tieba", "1"): ("thread",),
    ("tieba", "0"): None,
    ("dy", "aweme_general"): None,
    ("dy", "aweme_video_web"): ("video",),
    ("dy", "aweme_user_web"): ("user",),
    ("dy", "aweme_live"): ("live",),
    ("wb", "1"): None,
    ("wb", "61"): ("real_time",),
    ("wb", "60"): ("popular",),
    ("wb", "64"): ("video",),
}
