"""Scalar function queries."""

from pyspark.sql import functions as F

from catalog.base import query, record, table, text
from feedloom.functions import codes, nested, times
from feedloom.functions import text as tx
from feedloom.sources.embedded import (
    embedded_json,
    wb_note_payload,
    xhs_creator_payload,
    xhs_note_payload,
)
from feedloom.session import spread

STRIPPED = (
    "regexp_replace(regexp_replace(regexp_replace(html, "
    "'<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gs'), '<[^>]+>', '', 'g'), "
    r"'^\s+|\s+$', '', 'g')"
)


@query("html_text", f"SELECT page_id, {STRIPPED} AS text FROM pages")
def html_text(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "html")).select(
        "page_id", tx.strip_html("html").alias("text")
    )


@query(
    "html_text_short",
    "SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS text FROM pages",
)
def html_text_short(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "html")).select(
        "page_id", tx.strip_tags_short("html").alias("text")
    )


@query(
    "page_title",
    "SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages",
)
def page_title(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title")
    )


@query(
    "html_unescape",
    """SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(
         regexp_extract(html, '<title>(.*?)</title>', 1, 's'),
         '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
         '&amp;?', '&', 'g') AS title FROM pages""",
)
def html_unescape(spark, d):
    return table(spark, d, "pages").select(
        "page_id",
        tx.html_unescape(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"),
    )


@query(
    "url_params",
    r"""WITH q AS (SELECT page_id, url, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages)
    SELECT page_id,
      nullif(regexp_extract(q, '(?:^|&)page=([^&]+)', 1), '') AS page,
      nullif(regexp_extract(q, '(?:^|&)ref=([^&]+)', 1), '') AS ref,
      nullif(regexp_extract(q, '(?:^|&)utm_source=([^&]+)', 1), '') AS utm_source,
      len(list_distinct(regexp_extract_all(q, '(?:^|&)([^&=]+)=[^&]+', 1)))::INTEGER AS n_params
    FROM q""",
)
def url_params(spark, d):
    params = table(spark, d, "pages").select("page_id", tx.url_params("url").alias("p"))
    return params.select(
        "page_id",
        *[F.try_element_at("p", F.lit(k)).alias(k) for k in ("page", "ref", "utm_source")],
        F.size("p").alias("n_params"),
    )


@query(
    "url_parts",
    r"""SELECT page_id,
      string_split(string_split(url, '?')[1], '/')[-1] AS last_part,
      string_split(string_split(url, '?')[1], '/')[-2] AS folder,
      CASE WHEN contains(url, '/answer/') THEN 'answer' WHEN contains(url, '/p/') THEN 'article'
           WHEN contains(url, '/zvideo/') THEN 'zvideo' ELSE '' END AS kind
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '.com/', '.com/answer/')
            WHEN 1 THEN replace(url, '.com/', '.com/p/') WHEN 2 THEN replace(url, '.com/', '.com/zvideo/')
            ELSE url END AS url FROM pages)""",
)
def url_parts(spark, d):
    kinds = {0: ".com/answer/", 1: ".com/p/", 2: ".com/zvideo/"}
    url = F.col("url")
    for k, part in kinds.items():
        url = F.when(F.col("page_id") % 4 == k, F.replace("url", F.lit(".com/"), F.lit(part))).otherwise(url)
    return table(spark, d, "pages").select("page_id", url.alias("url")).select(
        "page_id",
        tx.last_segment("url").alias("last_part"),
        tx.segment_from_end("url", 2).alias("folder"),
        tx.url_kind("url").alias("kind"),
    )


@query(
    "note_ref",
    """SELECT doc_id, 'n' || doc_id AS note_id, source || '/=' AS xsec_token,
         CASE WHEN lang = 'en' THEN 'pc search' ELSE '' END AS xsec_source FROM documents""",
)
def note_ref(spark, d):
    # The token holds escaped characters, one of them a slash.
    tail = F.when(F.col("lang") == "en", "&xsec_source=pc+search").otherwise("&xsec_source=")
    url = text(
        "https://host.example/explore/n", F.col("doc_id"), "?xsec_token=", F.col("source"),
        "%2F%3D", tail,
    )
    return table(spark, d, "documents").select("doc_id", tx.note_ref(url).alias("r")).select(
        "doc_id", "r.*"
    )


@query(
    "content_urls",
    """SELECT doc_id, 'https://www.bilibili.com/video/av' || doc_id AS bili,
      'https://www.douyin.com/video/' || doc_id AS dy, 'https://www.kuaishou.com/short-video/' || doc_id AS ks,
      'https://m.weibo.cn/detail/' || doc_id AS wb, 'https://tieba.baidu.com/p/' || doc_id AS tieba,
      'https://www.xiaohongshu.com/explore/' || doc_id AS xhs FROM documents""",
)
def content_urls(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", *[tx.content_url(p, "doc_id").alias(p) for p in tx.CONTENT_URL]
    )


@query(
    "first_int",
    """SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(text, '[0-9]+', 0), '') AS BIGINT), 0) AS n
       FROM documents""",
)
def first_int(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.first_int("text").alias("n"))


@query(
    "kv_text",
    """SELECT event_id, user_id::VARCHAR AS a, event_type AS b, 2 AS n_keys,
         'a=' || user_id || ';b=' || event_type AS kv FROM events""",
)
def kv_text(spark, d):
    raw = text("a=old; b=", F.col("event_type"), ";c=1=2; lone ; a=", F.col("user_id"), "; ")
    return table(spark, d, "events").select("event_id", tx.kv_to_map(raw).alias("m")).select(
        "event_id",
        F.col("m")["a"].alias("a"),
        F.col("m")["b"].alias("b"),
        F.size("m").alias("n_keys"),
        tx.map_to_kv("m").alias("kv"),
    )


@query(
    "location_text",
    """SELECT o_orderkey, trim(o_orderpriority) AS place, left(o_orderpriority, 3) AS cut,
         coalesce(nullif(o_orderstatus, 'P'), 'none') AS status FROM orders""",
)
def location_text(spark, d):
    raw = F.when(F.col("o_orderkey") % 2 == 0, text("发布于 ", F.col("o_orderpriority"))).otherwise(
        text("来自", F.col("o_orderpriority"))
    )
    filled = nested.text_or(F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")), F.lit("none"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        tx.strip_location(raw).alias("place"),
        tx.truncate("o_orderpriority", 3).alias("cut"),
        filled.alias("status"),
    )


@query(
    "page_fields",
    """SELECT event_id, event_type AS place, strftime(ts, '%Y-%m-%d %H:%M') AS posted,
         event_type || '年' AS age, user_id AS relations,
         CASE WHEN event_id % 3 = 0 THEN 'M' WHEN event_id % 3 = 1 THEN 'F' ELSE 'unknown' END AS gender,
         event_type || '!' AS title FROM events""",
)
def page_fields(spark, d):
    css = F.when(F.col("event_id") % 3 == 0, "sex_male").when(F.col("event_id") % 3 == 1, "sex_female")
    page = text(
        '<span class="tail-info">IP属地:', F.col("event_type"), "</span>",
        '<span class="tail-info">', F.date_format("ts", "yyyy-MM-dd HH:mm"), "</span>",
        "<span>吧龄:", F.col("event_type"), "年</span>",
        '<span class="concern_num">(<a href="#">', F.col("user_id"), "</a>)</span>",
        '<i class="', F.coalesce(css, F.lit("plain")), '"></i>',
    )
    forum = F.col("event_type")
    title = text(F.col("event_type"), "!【", forum, "】_百度贴吧")
    return table(spark, d, "events").select(
        "event_id",
        tx.page_location(page).alias("place"),
        tx.page_time(page).alias("posted"),
        tx.page_site_age(page).alias("age"),
        tx.page_relation_count(page).alias("relations"),
        tx.page_gender(page).alias("gender"),
        tx.drop_title_suffix(title, forum).alias("title"),
    )


@query(
    "json_payload",
    """SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""",
)
def json_payload(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.from_json("props", "k BIGINT")["k"].alias("k")
    )


@query(
    "undefined_repair",
    """SELECT event_id, event_id AS b, user_id AS d FROM events""",
)
def undefined_repair(spark, d):
    raw = text('{"a":undefined,"b":', F.col("event_id"), ',"c":[undefined],"d":', F.col("user_id"), "}")
    fixed = tx.repair_undefined(raw, all_as_text=True)
    nulls = tx.repair_undefined(text('{"a":undefined,"d":', F.col("user_id"), "}"), all_as_text=False)
    return table(spark, d, "events").select(
        "event_id",
        F.from_json(fixed, "a STRING, b BIGINT, c ARRAY<STRING>")["b"].alias("b"),
        F.from_json(nulls, "a STRING, d BIGINT")["d"].alias("d"),
    )


@query(
    "snake_names",
    """SELECT o_orderkey AS note_id, o_custkey AS user_id, o_orderstatus AS ip_location,
         o_orderpriority AS first_tag FROM orders""",
)
def snake_names(spark, d):
    orders = table(spark, d, "orders")
    nested_record = record(
        noteId=F.col("o_orderkey"),
        userInfo=record(userId=F.col("o_custkey"), IPLocation=F.col("o_orderstatus")),
        tagList=F.array(record(tagName=F.col("o_orderpriority"))),
    )
    camel = orders.select(nested_record.alias("r"))
    snake = camel.select(nested.rename_snake("r", camel.schema["r"].dataType).alias("r"))
    return snake.select(
        "r.note_id", "r.user_info.user_id", "r.user_info.ip_location",
        F.col("r.tag_list")[0]["tag_name"].alias("first_tag"),
    )


@query(
    "embedded_note",
    """SELECT doc_id, text AS body, lang AS user_name, source AS post_source FROM documents""",
)
def embedded_note(spark, d):
    """State blocks of three page kinds, read back from the page text."""
    body = F.to_json(record(t=F.col("text")))
    # A page cannot hold a closing script tag inside its state.
    state = text('{"note":{"noteDetailMap":{"n', F.col("doc_id"), '":{"note":', body, '}}},"x":undefined}')
    note_page = text("<html><script>window.__INITIAL_STATE__=", state, "</script></html>")
    user_page = text(
        '<script>window.__INITIAL_STATE__={"a":undefined,"user":{"userPageData":{"name":"',
        F.col("lang"), '"}}}</script>',
    )
    post_page = text(
        'x <script>var $render_data = [{\n"status":{"src":"', F.col("source"),
        '"}}][0] || {};</script>',
    )
    return table(spark, d, "documents").select(
        "doc_id",
        F.get_json_object(xhs_note_payload(note_page, text("n", F.col("doc_id"))), "$.t").alias("body"),
        F.get_json_object(xhs_creator_payload(user_page), "$.name").alias("user_name"),
        F.get_json_object(wb_note_payload(post_page), "$.src").alias("post_source"),
    )


@query(
    "embedded_absent",
    "SELECT page_id, NULL::VARCHAR AS state FROM pages",
)
def embedded_absent(spark, d):
    return table(spark, d, "pages").select("page_id", embedded_json("html", "zhihu").alias("state"))


@query(
    "asset_hosts",
    """SELECT p_partkey, host, host || '/' ||
         CASE WHEN p_partkey % 2 = 0 THEN 'spectrum/' ELSE '' END || 'a' || p_partkey ||
         '?imageView2/format/png' AS asset_url
       FROM part, (VALUES ('https://sns-img-qc.xhscdn.com'), ('https://sns-img-hw.xhscdn.com'),
         ('https://sns-img-bd.xhscdn.com'), ('https://sns-img-qn.xhscdn.com')) AS h(host)""",
)
def asset_hosts(spark, d):
    from feedloom.operators.joins import expand_hosts

    folder = F.when(F.col("p_partkey") % 2 == 0, "spectrum/").otherwise("other/")
    url = text("https://host.example/", folder, "a", F.col("p_partkey"))
    assets = table(spark, d, "part").select("p_partkey", tx.trace_id(url).alias("asset"))
    return expand_hosts(assets, "asset").drop("asset")


@query(
    "epoch_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_s, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_ms,
         strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS in_china, strftime(ts, '%Y-%m-%d') AS day,
         epoch(date_trunc('second', ts))::BIGINT AS back, 0::BIGINT AS bad FROM events""",
)
def epoch_text(spark, d):
    instant = F.col("ts").cast("timestamp")
    seconds, millis = F.unix_seconds(instant), F.unix_millis(instant)
    return table(spark, d, "events").select(
        "event_id",
        times.epoch_text(seconds).alias("from_s"),
        times.epoch_text(millis).alias("from_ms"),
        times.epoch_text(millis, times.CHINA).alias("in_china"),
        times.epoch_day(seconds).alias("day"),
        times.text_epoch(times.epoch_text(seconds)).alias("back"),
        times.text_epoch(text("on ", times.epoch_text(seconds))).alias("bad"),
    )


@query(
    "clock_forms",
    """SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS s,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS now, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS today FROM events""",
)
def clock_forms(spark, d):
    """The clock functions at injected instants."""
    as_of = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(
        "event_id",
        times.now_ms(as_of).alias("ms"),
        times.now_seconds(as_of).alias("s"),
        times.now_text(as_of).alias("now"),
        times.today_text(as_of, times.CHINA).alias("today"),
    )


@query(
    "mail_time",
    """SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - 28800 AS instant,
         epoch(date_trunc('second', ts))::BIGINT AS wall,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || '+08:00' AS china FROM events""",
)
def mail_time(spark, d):
    raw = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0800 "), F.date_format("ts", "yyyy"))
    return table(spark, d, "events").select(
        "event_id",
        times.mail_instant(raw).alias("instant"),
        times.mail_wallclock_epoch(raw).alias("wall"),
        times.mail_china_text(raw).alias("china"),
    )


@query(
    "day_bounds",
    """SELECT o_orderkey, epoch(o_orderdate::DATE)::BIGINT AS day_begin,
         epoch(o_orderdate::DATE)::BIGINT + 86399 AS day_end FROM orders""",
)
def day_bounds(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        times.day_begin("o_orderdate").alias("day_begin"),
        times.day_end("o_orderdate").alias("day_end"),
    )


@query(
    "day_bounds_of_zones",
    """SELECT o_orderkey, epoch(o_orderdate::DATE)::BIGINT - 28800 AS china_begin, epoch(o_orderdate::DATE)::BIGINT + 57599 AS china_end,
         epoch(o_orderdate::DATE)::BIGINT - 19800 AS india_begin FROM orders""",
)
def day_bounds_of_zones(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        times.day_begin("o_orderdate", "+08:00").alias("china_begin"),
        times.day_end("o_orderdate", "+08:00").alias("china_end"),
        times.day_begin("o_orderdate", "Asia/Kolkata").alias("india_begin"),
    )


@query(
    "day_series",
    """SELECT x::DATE AS day, count(event_id)::BIGINT AS n
       FROM range(DATE '2023-12-30', DATE '2024-02-03', INTERVAL 1 DAY) r(x)
       LEFT JOIN events ON ts::DATE = x::DATE GROUP BY 1""",
)
def day_series(spark, d):
    days = spark.range(1).select(F.explode(times.day_series("2023-12-30", "2024-02-02")).alias("day"))
    counts = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("event_id").alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "array_picks",
    r"""WITH a AS (SELECT page_id, string_split(url, '/')[3:] AS p, url FROM pages)
    SELECT page_id, p[2] AS second, CASE WHEN len(p) > 1 THEN p[-1] END AS last_part,
      array_to_string(p[1:2], ',') AS first_two,
      nullif(regexp_extract(url, '/(m\.[^/]*)', 1), '') AS mobile, array_to_string(p, ',') AS joined
    FROM a""",
)
def array_picks(spark, d):
    parts = F.slice(F.split("url", "/"), F.lit(3), F.length("url"))
    arrays = table(spark, d, "pages").select("page_id", parts.alias("p"))
    none = F.array().cast("array<string>")
    return arrays.select(
        "page_id",
        nested.second("p").alias("second"),
        nested.last_of_many(nested.first_filled(none, "p")).alias("last_part"),
        nested.join_list(nested.take("p", 2)).alias("first_two"),
        nested.first_match("p", lambda x: F.startswith(x, F.lit("m."))).alias("mobile"),
        nested.join_list("p").alias("joined"),
    )


@query(
    "largest_stream",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN a >= b AND a >= c THEN 'part' WHEN b >= c THEN 'supplier' ELSE 'quantity' END AS url
      FROM (SELECT *, l_partkey AS a, l_suppkey * 20 AS b, l_quantity::BIGINT * 40 AS c FROM lineitem)""",
)
def largest_stream(spark, d):
    streams = F.array(
        record(size=F.col("l_partkey"), url=F.lit("part")),
        record(size=F.col("l_suppkey") * 20, url=F.lit("supplier")),
        record(size=F.col("l_quantity").cast("bigint") * 40, url=F.lit("quantity")),
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", nested.largest(streams).alias("url")
    )


@query(
    "tag_map_json",
    """SELECT o_orderkey, '{"status":"' || o_orderstatus || '","级":"' || o_orderpriority || '"}' AS tags,
         o_orderstatus AS first_value FROM orders""",
)
def tag_map_json(spark, d):
    tags = F.array(
        record(k=F.lit("status"), v=F.lit("old")),
        record(k=F.lit("级"), v=F.col("o_orderpriority")),
        record(k=F.lit("status"), v=F.col("o_orderstatus")),
        record(k=F.lit(None).cast("string"), v=F.lit("dropped")),
    )
    return table(spark, d, "orders").select(
        "o_orderkey", nested.entries_to_map(tags, "k", "v").alias("m")
    ).select(
        "o_orderkey", nested.map_json("m").alias("tags"), nested.first_map_value("m").alias("first_value")
    )


@query(
    "gender_codes",
    """SELECT c_custkey,
      CASE c_nationkey WHEN 1 THEN 'F' WHEN 0 THEN 'M' END AS xhs,
      CASE c_nationkey WHEN 1 THEN 'M' WHEN 0 THEN 'F' ELSE 'unknown' END AS zhihu,
      CASE c_nationkey WHEN 1 THEN 'M' WHEN 2 THEN 'F' ELSE 'unknown' END AS dy,
      CASE left(c_mktsegment, 1) WHEN 'F' THEN 'F' ELSE 'M' END AS ks,
      CASE left(lower(c_mktsegment), 1) WHEN 'f' THEN 'F' ELSE 'M' END AS wb FROM customer""",
)
def gender_codes(spark, d):
    initial = F.substring("c_mktsegment", 1, 1)
    return table(spark, d, "customer").select(
        "c_custkey",
        *[codes.gender(p, "c_nationkey").alias(p) for p in ("xhs", "zhihu", "dy")],
        codes.gender("ks", initial).alias("ks"),
        codes.gender("wb", F.lower(initial)).alias("wb"),
    )


@query(
    "page_counts",
    """SELECT doc_id, ceil(n_chars / 20.0)::BIGINT AS pages, n_chars // 10 + 1 AS pages_over FROM documents""",
)
def page_counts(spark, d):
    from feedloom.operators.ranking import page_count

    return table(spark, d, "documents").select(
        "doc_id",
        page_count("n_chars", 20).alias("pages"),
        page_count("n_chars", 10, "floor_plus_one").alias("pages_over"),
    )
