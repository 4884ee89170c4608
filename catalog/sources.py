"""Source queries: envelopes, pages, seeds, parametrised reads."""

from pyspark.sql import functions as F

from catalog.base import SEEN, query, record, table, text
from feedloom.functions.text import tokens
from feedloom.normalize import xhs
from feedloom.operators.sets import union_sources
from feedloom.session import shared_path
from feedloom.sources.pages import PageSpec, Take, at, parse_html
from feedloom.sources.responses import explode_payload, read_responses, unwrap_envelope
from feedloom.sources.tables import first_row, lookup, read_json_array, read_pages, read_table


def _body(platform):
    """Response texts of one platform: good, failed, blocked, and cut off."""
    data = F.to_json(record(id=F.col("event_id"), what=F.col("event_type")))
    good = {
        "xhs": text('{"success":true,"data":', data, "}"),
        "bili": text('{"code":0,"data":', data, "}"),
        "ks": text('{"data":', data, "}"),
        "wb": text('{"ok":1,"data":', data, "}"),
        "zhihu": data,
        "dy": data,
        "tieba": text("<html>", F.col("event_type"), "</html>"),
    }[platform]
    bad = {
        "xhs": '{"success":false,"code":1,"msg":"no"}',
        "bili": '{"code":-1,"message":"no"}',
        "ks": '{"errors":["no"]}',
        "wb": '{"ok":0,"msg":"no"}',
        "zhihu": '{"error":{"message":"no"}}',
        "dy": "blocked",
        "tieba": "",
    }[platform]
    broken = F.lit('{"data":{"id":1') if platform not in ("dy", "tieba") else F.lit("blocked")
    return (
        F.when(F.col("event_type") == "error", bad)
        .when(F.col("event_type") == "click", broken)
        .otherwise(good)
    )


_PLATFORMS = ("xhs", "bili", "ks", "wb", "zhihu", "dy", "tieba")


def _unwrapped(spark, d):
    events = table(spark, d, "events")
    for p in _PLATFORMS:
        body = events.select("event_id", F.lit(p).alias("platform"), _body(p).alias("body"))
        yield unwrap_envelope(body, p)


_GOOD = "event_type NOT IN ('error', 'click')"
_JSON = "'{\"id\":' || event_id || ',\"what\":\"' || event_type || '\"}'"


@query(
    "envelope_ok",
    " UNION ALL ".join(
        f"SELECT event_id, '{p}' AS platform, "
        + ("'<html>' || event_type || '</html>'" if p == "tieba" else _JSON)
        + f" AS payload FROM events WHERE {_GOOD}"
        for p in _PLATFORMS
    ),
)
def envelope_ok(spark, d):
    return union_sources(*[ok for ok, _ in _unwrapped(spark, d)])


@query(
    "envelope_errors",
    " UNION ALL ".join(
        f"""SELECT event_id, '{p}' AS platform, CASE WHEN event_type = 'error' THEN {bad}
            ELSE {broken} END AS error FROM events WHERE NOT ({_GOOD})"""
        for p, bad, broken in (
            ("xhs", "'no'", "'unreadable response'"),
            ("bili", "'no'", "'unreadable response'"),
            ("ks", "'[\"no\"]'", "'unreadable response'"),
            ("wb", "'no'", "'unreadable response'"),
            ("zhihu", "'no'", "'unreadable response'"),
            ("dy", "'blocked'", "'blocked'"),
            ("tieba", "''", "'blocked'"),
        )
    ),
)
def envelope_errors(spark, d):
    return union_sources(*[bad for _, bad in _unwrapped(spark, d)]).drop("body")


@query(
    "landed_pages_of_items",
    """SELECT o_orderkey, 0 AS payload_pos, '{"n":"' || o_orderstatus || '"}' AS payload FROM orders
       UNION ALL SELECT o_orderkey, 1, '{"n":"' || o_orderpriority || '"}' FROM orders""",
)
def landed_items(spark, d):
    items = F.array(record(n=F.col("o_orderstatus")), record(n=F.col("o_orderpriority")))
    pages = table(spark, d, "orders").select("o_orderkey", F.to_json(record(items=items)).alias("payload"))
    return explode_payload(pages, "items")


@query(
    "landed_responses",
    f"""SELECT 'n' || doc_id AS note_id, left(text, 255) AS title, text AS "desc", 'xhs' AS platform, {SEEN}::BIGINT
        AS last_modify_ts FROM documents WHERE lang <> 'fr'""",
)
def landed_responses(spark, d):
    """Land responses as lines, scan them, unwrap, normalise."""
    path = shared_path(spark, "landed")
    data = record(note_id=text("n", F.col("doc_id")), desc=F.col("text"))
    body = F.to_json(record(success=F.col("lang") != "fr", data=data))
    table(spark, d, "documents").select(body.alias("value")).write.text(path)
    ok, _ = unwrap_envelope(read_responses(spark, path, "xhs", "note"), "xhs")
    notes = xhs.normalize_note(ok, SEEN)
    return notes.select("note_id", "title", "desc", F.lit("xhs").alias("platform"), "last_modify_ts")


LINKS = PageSpec(
    blocks=((at("nav"), at("ul"), at("li", child=True)),),
    fields={
        "href": Take((at("a", child=True),), "href"),
        "label": Take((at("a", child=True),)),
        "title": Take((at("title"),), whole_page=True),
    },
)


@query(
    "html_records",
    r"""SELECT page_id, unnest(range(len(h))) AS record_pos, unnest(h) AS href, unnest(t) AS label, title FROM (
         SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h,
           regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS t,
           regexp_replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'),
             '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS title FROM pages)""",
)
def html_records(spark, d):
    """Links of the navigation block of every page, as records."""
    return parse_html(table(spark, d, "pages").select("page_id", "html"), LINKS)


@query(
    "read_table_params",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000.0""",
)
def read_table_params(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("feedloom_orders")
    return read_table(
        spark,
        "SELECT o_orderkey, o_totalprice FROM feedloom_orders WHERE o_orderstatus = :status AND o_totalprice > :floor",
        {"status": "P", "floor": 100000.0},
    )


@query(
    "lookup_rows",
    """SELECT event_id, user_id, props FROM events WHERE user_id = 8 AND event_type = 'click'""",
)
def lookup_rows(spark, d):
    return lookup(table(spark, d, "events"), user_id=8, event_type="click").select("event_id", "user_id", "props")


@query("first_row", """SELECT n_nationkey, n_regionkey FROM nation WHERE n_name = 'NATION_7'""")
def one_row(spark, d):
    """The existence probe of a natural key."""
    return first_row(lookup(table(spark, d, "nation"), n_name="NATION_7")).select("n_nationkey", "n_regionkey")


@query(
    "json_arrays",
    """SELECT event_id, event_type FROM events UNION ALL SELECT -event_id, 'echo' FROM events""",
)
def json_arrays(spark, d):
    """Landed JSON arrays (two records each), read as rows with a declared schema."""
    path = shared_path(spark, "arrays")
    pair = F.array(
        record(event_id=F.col("event_id"), event_type=F.col("event_type")),
        record(event_id=-F.col("event_id"), event_type=F.lit("echo")),
    )
    table(spark, d, "events").select(F.to_json(pair).alias("value")).write.text(path)
    return read_json_array(spark, path, "event_id BIGINT, event_type STRING", per_line=True)


@query(
    "tokens_per_document",
    r"""SELECT doc_id, len(regexp_extract_all(text, '([\p{L}\p{N}]+)', 1))::INTEGER AS n FROM documents""",
)
def tokens_per_document(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tokens("text")).alias("n"))


@query("pages_read", "SELECT page_id, url, length(html)::BIGINT AS n_chars FROM pages")
def pages_read(spark, d):
    """The page table through its reader."""
    return read_pages(spark, f"{d}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("bigint").alias("n_chars")
    )
