"""JSON embedded in page scripts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom.functions.nested import ColumnOrName, col
from feedloom.functions.text import repair_undefined

# Where each kind of page keeps its state.
_STATE = {
    "xhs_note": r"(?s)window\.__INITIAL_STATE__=(\{.*?\})</script>",
    "xhs_creator": r"(?s)<script>window\.__INITIAL_STATE__=(.+?)</script>",
    "wb": r"(?s)var \$render_data = (\[.*?\])\[0\]",
    "zhihu": r"""(?s)<script[^>]*\bid=["']?js-initialData["']?[^>]*>(.*?)</script>""",
}


def embedded_json(html: ColumnOrName, kind: str) -> Column:
    """Text of the embedded JSON, repaired; NULL when the page has none."""
    found = F.nullif(F.trim(F.regexp_extract(col(html), _STATE[kind], 1)), F.lit(""))
    if kind == "xhs_note":
        return F.nullif(repair_undefined(found, all_as_text=True), F.lit("{}"))
    if kind == "xhs_creator":
        return repair_undefined(found, all_as_text=False)
    return found


def xhs_note_payload(html: ColumnOrName, note_id: ColumnOrName) -> Column:
    """The note of a detail page as JSON text (keys as in the page, camel case)."""
    state = F.from_json(
        embedded_json(html, "xhs_note"),
        "note STRUCT<noteDetailMap: MAP<STRING, STRUCT<note: STRING>>>",
    )
    return F.try_element_at(state["note"]["noteDetailMap"], col(note_id))["note"]


def xhs_creator_payload(html: ColumnOrName) -> Column:
    """The creator of a profile page as JSON text."""
    return F.get_json_object(embedded_json(html, "xhs_creator"), "$.user.userPageData")


def wb_note_payload(html: ColumnOrName) -> Column:
    """The post of a detail page as JSON text."""
    return F.get_json_object(embedded_json(html, "wb"), "$[0].status")
