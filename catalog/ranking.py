"""Caps, pages, quotas, named orders."""

from functools import reduce

from pyspark.sql import functions as F

from catalog.base import query, table
from feedloom.functions.codes import CommentOrder, ContentOrder
from feedloom.operators import orders as od
from feedloom.operators import ranking as rk
from feedloom.operators.filters import keyword_search
from feedloom.session import spread


@query(
    "first_n_comments",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
       FROM conversations) WHERE rn <= 3""",
)
def first_n_comments(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return rk.first_n(turns, ["conv_id"], [F.col("turn")], 3)


@query(
    "first_n_with_children",
    """WITH n AS (SELECT o_orderkey, o_custkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines
                  FROM orders),
       u AS (SELECT *, coalesce(sum(1 + lines) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM n)
       SELECT o_custkey, o_orderkey, lines::BIGINT AS lines FROM u WHERE used < 12""",
)
def first_n_with_children(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines")
    )
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    counted = orders.join(lines, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    return rk.first_n(counted, ["o_custkey"], [F.col("o_orderkey")], 12, children="lines")


_COUNTED, _PLAIN = ("xhs", "wb", "ks", "dy"), ("tieba", "bili")


@query(
    "comment_caps_of_platforms",
    f"""WITH r AS (SELECT conv_id, turn, row_number() OVER w AS rn,
           coalesce(sum(1 + len(role) - 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING), 0) AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT p AS platform, conv_id, turn FROM r, (VALUES {", ".join(f"('{p}')" for p in _COUNTED)}) v(p) WHERE used < 6
        UNION ALL SELECT p, conv_id, turn FROM r, (VALUES {", ".join(f"('{p}')" for p in _PLAIN)}) v(p) WHERE rn <= 6
        UNION ALL SELECT 'zhihu', conv_id, turn FROM r""",
)
def comment_caps_of_platforms(spark, d):
    """The comment cap under the rule of each platform."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", (F.length("role") - 4).alias("replies"))
    out = None
    for platform in (*_COUNTED, *_PLAIN, "zhihu"):
        part = rk.cap_comments(turns, platform, ["conv_id"], [F.col("turn")], 6, "replies")
        part = part.select(F.lit(platform).alias("platform"), "conv_id", "turn")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "first_n_large",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)
       AS rn FROM events) WHERE rn <= 1500""",
)
def first_n_large(spark, d):
    """A cap above the group limit: exact positions from range-partitioned pieces."""
    events = table(spark, d, "events").select("event_type", "event_id", "ts")
    return rk.first_n(events, ["event_type"], [F.col("ts"), F.col("event_id")], 1500).drop("ts")


@query(
    "first_n_salted",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)
       AS rn FROM events) WHERE rn <= 200""",
)
def first_n_salted(spark, d):
    events = table(spark, d, "events").select("event_type", "event_id", "ts")
    return rk.first_n(events, ["event_type"], [F.col("ts"), F.col("event_id")], 200).drop("ts")


@query(
    "first_pages_per_keyword",
    """WITH h AS (SELECT doc_id, n_chars, k FROM documents, (VALUES ('tion'), ('ung'), ('oi')) v(k)
                  WHERE contains(lower(text), k)),
       r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) AS rn FROM h)
       SELECT k AS source_keyword, doc_id, ceil(rn / 20.0)::BIGINT AS page FROM r WHERE rn > 20 AND rn <= 60""",
)
def first_pages_per_keyword(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "n_chars"))
    hits = keyword_search(docs, ["tion", "ung", "oi"], ["text"]).select("source_keyword", "doc_id", "n_chars")
    order = [F.desc("n_chars"), F.col("doc_id")]
    return rk.first_pages(hits, ["source_keyword"], order, 20, 50, start_page=2).drop("n_chars")


@query(
    "daily_quota",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS rd
                  FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21'),
       t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE, ts, event_id) AS rt
             FROM r WHERE rd <= 5)
       SELECT event_type, event_id, ts FROM t WHERE rt <= 40""",
)
def daily_quota(spark, d):
    events = table(spark, d, "events").select("event_type", "event_id", "ts")
    order = [F.col("ts"), F.col("event_id")]
    return rk.daily_quota(events, ["event_type"], "ts", order, "2024-01-03", "2024-01-20", 5, 40)


@query(
    "total_quota",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type
         ORDER BY ts::DATE, ts, event_id) AS rt FROM events
         WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21') WHERE rt <= 40""",
)
def total_quota(spark, d):
    events = table(spark, d, "events").select("event_type", "event_id", "ts")
    order = [F.col("ts"), F.col("event_id")]
    out = rk.daily_quota(events, ["event_type"], "ts", order, "2024-01-03", "2024-01-20", total=40)
    return out.drop("ts")


@query(
    "latest_row",
    """SELECT user_id, event_type, event_id, props FROM (SELECT *, row_number() OVER (
         PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_row(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", "event_id", "props", "ts")
    return rk.latest(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(
    "page_slice",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""",
)
def page_slice(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rk.page(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20)


@query(
    "positions",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey
         ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS position FROM lineitem""",
)
def positions(spark, d):
    ids = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
    lines = table(spark, d, "lineitem").select(*ids, "l_shipdate", "l_extendedprice")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return rk.numbered(lines, ["l_suppkey"], order).select(
        *ids, F.col("position").cast("bigint").alias("position")
    )


_ORDERS = {
    "most_liked": "o_totalprice DESC",
    "latest": "o_orderdate DESC",
    "oldest": "o_orderdate",
}


@query(
    "content_orders",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS how, o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (
            PARTITION BY o_custkey ORDER BY {by}, o_orderkey) AS rn FROM orders) WHERE rn <= 2"""
        for name, by in _ORDERS.items()
    ),
)
def content_orders(spark, d):
    """The first two contents of each creator in three named orders."""
    columns = {"like_count": "o_totalprice", "created_ts": "o_orderdate"}
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    out = None
    for name in _ORDERS:
        order = od.content_order(ContentOrder(name), "o_orderkey", columns)
        part = rk.first_n(orders, ["o_custkey"], order, 2).select(
            F.lit(name).alias("how"), "o_custkey", "o_orderkey"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "relevance_order",
    """WITH h AS (SELECT doc_id, n_chars, k, (len(lower(text)) - len(replace(lower(text), k, ''))) // len(k) AS hits
                  FROM documents, (VALUES ('tion'), ('ung')) v(k) WHERE contains(lower(text), k))
       SELECT k AS source_keyword, doc_id, hits::BIGINT AS hits FROM (SELECT *, row_number() OVER (
         PARTITION BY k ORDER BY hits DESC, n_chars DESC, doc_id) AS rn FROM h) WHERE rn <= 25""",
)
def relevance_order(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "n_chars"))
    hits = keyword_search(docs, ["tion", "ung"], ["text"])
    counted = hits.select(
        "source_keyword", "doc_id", "n_chars", od.keyword_hits("text", "source_keyword").alias("hits")
    )
    order = [F.desc("hits"), F.desc("n_chars"), F.col("doc_id")]
    return rk.first_n(counted, ["source_keyword"], order, 25).drop("n_chars")


@query(
    "top_relevant_page",
    """SELECT doc_id, source FROM documents WHERE contains(lower(text), 'tion')
       ORDER BY (len(lower(text)) - len(replace(lower(text), 'tion', ''))) // 4 DESC, n_chars DESC, doc_id
       LIMIT 20""",
)
def top_relevant_page(spark, d):
    docs = spread(table(spark, d, "documents"))
    hits = keyword_search(docs, ["tion"], ["text"])
    order = od.content_order(("tieba", "2"), "doc_id", {"created_ts": "n_chars"}, text="text")
    return rk.page(hits, order, 1, 20).select("doc_id", "source")


@query(
    "comment_orders",
    """SELECT 'heat' AS how, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (
         PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
         FROM lineitem) WHERE rn = 1
       UNION ALL SELECT 'time', l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (
         PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
         FROM lineitem) WHERE rn = 1""",
)
def comment_orders(spark, d):
    columns = {"like_count": "l_quantity", "created_ts": "l_shipdate"}
    lines = table(spark, d, "lineitem")
    tie = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice")]
    out = None
    for how in (CommentOrder.HEAT, CommentOrder.TIME):
        order = [*od.comment_order(how, "l_linenumber", columns), *tie]
        part = rk.latest(lines, ["l_orderkey"], order).select(
            F.lit(how.value).alias("how"), "l_orderkey", "l_linenumber", "l_partkey"
        )
        out = part if out is None else out.unionByName(part)
    return out


_MORE_ORDERS = {
    "general": "hits DESC, o_orderdate DESC", "most_clicked": "o_custkey DESC", "most_danmaku": "danmaku DESC",
    "most_collected": "collected DESC",
}
_MORE_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS how, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (
      PARTITION BY o_orderpriority ORDER BY {by}, o_orderkey) AS rn FROM o) WHERE rn <= 30"""
    for name, by in _MORE_ORDERS.items()
)


@query(
    "content_orders_more",
    f"""WITH o AS (SELECT *, o_orderkey % 89 AS danmaku, o_orderkey % 97 AS collected,
      (len(body) - len(replace(body, '1', ''))) AS hits FROM (SELECT *, o_orderkey::VARCHAR AS body FROM orders)) {_MORE_SQL}""",
)
def content_orders_more(spark, d):
    """The first contents of each group in the orders that the query above leaves out."""
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders").withColumns(
        {"danmaku": key % 89, "collected": key % 97, "body": key.cast("string"), "source_keyword": F.lit("1")}
    )
    columns = {
        "created_ts": "o_orderdate", "view_count": "o_custkey", "danmaku_count": "danmaku", "collect_count": "collected",
    }
    parts = [
        rk.first_n(orders, ["o_orderpriority"], od.content_order(ContentOrder(name), "o_orderkey", columns), 30).select(
            F.lit(name).alias("how"), "o_orderpriority", "o_orderkey"
        )
        for name in _MORE_ORDERS
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "comments_by_heat_then_time",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_quantity DESC, l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
       WHERE rn <= 2""",
)
def comments_by_heat_then_time(spark, d):
    columns = {"like_count": "l_quantity", "created_ts": "l_shipdate"}
    order = od.comment_order(CommentOrder.HEAT_THEN_TIME, "l_linenumber", columns)
    tie = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice")]
    return rk.first_n(table(spark, d, "lineitem"), ["l_orderkey"], [*order, *tie], 2).select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    "first_n_in_pieces",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
       FROM events) WHERE rn <= 600""",
)
def first_n_in_pieces(spark, d):
    """A cap between 201 and 1000: salted pieces first."""
    events = table(spark, d, "events").select("event_type", "event_id", "ts")
    return rk.first_n(events, ["event_type"], [F.col("ts"), F.col("event_id")], 600).drop("ts")
