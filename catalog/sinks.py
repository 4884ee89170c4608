"""Sink queries: round trips, upserts, updates, layouts, manifests."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog.base import query, record, table, text
from feedloom.operators import media
from feedloom.operators.aggregates import next_run_ordinal
from feedloom.operators.joins import comments_of
from feedloom.session import shared_path
from feedloom.sinks import buckets, files, upsert

KEYS = ["user_id", "event_type"]


def _split_events(spark, d):
    """Events up to noon of 15 January are the table, later ones the updates."""
    events = table(spark, d, "events").select(
        "user_id", "event_type", "props", "value", "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("last_modify_ts"),
    )
    cut = 1705320000000
    return events.where(F.col("last_modify_ts") < cut), events.where(F.col("last_modify_ts") >= cut)


_STATE = """SELECT user_id, event_type, arg_max(props, (ts, event_id)) AS props, arg_max(value, (ts, event_id)) AS value,
  max(event_id) AS event_id, epoch_us(max(ts)) // 1000 AS last_modify_ts, epoch_us(min(ts)) // 1000 AS add_ts
  FROM events GROUP BY 1, 2"""
_ORDER = ["last_modify_ts", "event_id"]


def _target(spark, d):
    old, _ = _split_events(spark, d)
    rows = upsert.last_updates(old, KEYS, _ORDER, "last_modify_ts")
    return rows.withColumnRenamed("_first_seen", "add_ts")


@query("upsert_events", _STATE)
def upsert_events(spark, d):
    """Updates merged into a table: last payload wins, first add time stays."""
    _, new = _split_events(spark, d)
    return upsert.upsert(_target(spark, d), new, KEYS, _ORDER)


@query("upsert_repeated", _STATE)
def upsert_repeated(spark, d):
    """Merging the same updates twice changes nothing."""
    _, new = _split_events(spark, d)
    once = upsert.upsert(_target(spark, d), new, KEYS, _ORDER)
    return upsert.upsert(once, new, KEYS, _ORDER)


@query("upsert_versions", _STATE)
def upsert_versions(spark, d):
    """The db sink: each upsert writes the next version of the table folder."""
    path = shared_path(spark, "upsert")
    for part in _split_events(spark, d):
        files.sink(part, "db", path=path, keys=KEYS, order=_ORDER)
    return upsert.current(spark, path)


@query("upsert_merged_on_read", _STATE)
def upsert_merged_on_read(spark, d):
    """Batches appended as they come, the last one twice, and folded when read."""
    path = shared_path(spark, "batches")
    old, new = _split_events(spark, d)
    for batch, rows in ((0, old), (1, new), (1, new)):
        upsert.append_updates(rows, path, KEYS, _ORDER, batch)
    return upsert.read_upserts(spark, path, KEYS, _ORDER)


_LATE = """WITH e AS (
    SELECT *, ts < TIMESTAMP '2024-01-15 12:00:00' AS late,
      bool_or(ts < TIMESTAMP '2024-01-15 12:00:00') OVER w AS has_late,
      bool_or(ts >= TIMESTAMP '2024-01-15 12:00:00') OVER w AS has_first
    FROM events WINDOW w AS (PARTITION BY user_id, event_type))
  SELECT user_id, event_type, arg_max(props, (ts, event_id)) FILTER (late = has_late) AS props,
    arg_max(value, (ts, event_id)) FILTER (late = has_late) AS value,
    arg_max(event_id, (ts, event_id)) FILTER (late = has_late) AS event_id,
    epoch_us(max(ts) FILTER (late = has_late)) // 1000 AS last_modify_ts,
    epoch_us(min(ts) FILTER ((NOT late) = has_first)) // 1000 AS add_ts
  FROM e GROUP BY 1, 2"""


@query("upsert_late", _LATE)
def upsert_late(spark, d):
    """Updates that arrive last win, however old they are; the add time does not move."""
    late, first = _split_events(spark, d)
    rows = upsert.last_updates(first, KEYS, _ORDER, "last_modify_ts")
    return upsert.upsert(rows.withColumnRenamed("_first_seen", "add_ts"), late, KEYS, _ORDER)


@query("upsert_late_merged_on_read", _LATE)
def upsert_late_merged_on_read(spark, d):
    """The same by folders, the late updates in a run of their own."""
    path = shared_path(spark, "late")
    late, first = _split_events(spark, d)
    upsert.append_updates(first, path, KEYS, _ORDER, 7)
    upsert.append_updates(late, path, KEYS, _ORDER, 0, run="r000002")
    return upsert.read_upserts(spark, path, KEYS, _ORDER)


#: Arrival of the events: the middle of the month first, then its end, then its start.
_ARRIVAL = "CASE WHEN ts < TIMESTAMP '2024-01-08 00:00:00' THEN 2 WHEN ts < TIMESTAMP '2024-01-20 00:00:00' THEN 0 ELSE 1 END"
_IN_TURN = f"""WITH e AS (
    SELECT *, {_ARRIVAL} AS arrival FROM events
  ), w AS (
    SELECT *, max(arrival) OVER k AS last, min(arrival) OVER k AS first FROM e WINDOW k AS (PARTITION BY user_id, event_type))
  SELECT user_id, event_type, arg_max(props, (ts, event_id)) FILTER (arrival = last) AS props,
    arg_max(value, (ts, event_id)) FILTER (arrival = last) AS value,
    arg_max(event_id, (ts, event_id)) FILTER (arrival = last) AS event_id,
    epoch_us(max(ts) FILTER (arrival = last)) // 1000 AS last_modify_ts,
    epoch_us(min(ts) FILTER (arrival = first)) // 1000 AS add_ts
  FROM w GROUP BY 1, 2"""


def _arriving(spark, d):
    """The three parts of the events in the order in which they arrive."""
    events = table(spark, d, "events").select(
        "user_id", "event_type", "props", "value", "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("last_modify_ts"),
    )
    t = F.col("last_modify_ts")
    start, end = 1704672000000, 1705708800000  # 8 and 20 January
    return [events.where((t >= start) & (t < end)), events.where(t >= end), events.where(t < start)]


@query("upsert_buckets_in_turn", _IN_TURN)
def upsert_buckets_in_turn(spark, d):
    """Two writers in turn into a bucketed table, each batch handed over twice."""
    path = shared_path(spark, "buckets")
    for number, (writer, rows) in enumerate(zip(("search", "creator", "search"), _arriving(spark, d))):
        for _ in range(2):
            buckets.upsert_buckets(rows, path, KEYS, _ORDER, buckets=16, writer=writer, batch=number)
    return buckets.read_buckets(spark, path)


@query("upsert_folders_in_turn", _IN_TURN)
def upsert_folders_in_turn(spark, d):
    """The same merged on read: batches of a run, of a stream's checkpoint, of the run again."""
    path = shared_path(spark, "folders")
    first, second, third = _arriving(spark, d)
    upsert.append_updates(first, path, KEYS, _ORDER, 0)
    upsert.append_updates(second, path, KEYS, _ORDER, 0, run=upsert.run_of(spark, path, "checkpoint"))
    upsert.append_updates(third, path, KEYS, _ORDER, 1)
    return upsert.read_upserts(spark, path, KEYS, _ORDER)


@query(
    "upsert_keywords",
    """SELECT doc_id, k AS source_keyword, n_chars, 1::BIGINT AS last_modify_ts, 1::BIGINT AS add_ts FROM documents,
         (VALUES ('tion'), ('ung')) v(k) WHERE contains(lower(text), k)""",
)
def upsert_keywords(spark, d):
    """A store that keeps every keyword's hit of a content."""
    from feedloom.operators.filters import keyword_search

    docs = table(spark, d, "documents").select("doc_id", "n_chars", "text")
    hits = keyword_search(docs, ["tion", "ung"], ["text"]).select(
        "doc_id", "source_keyword", "n_chars", F.lit(1).cast("bigint").alias("last_modify_ts")
    )
    keys = upsert.keep_all_keywords(hits, ["doc_id"])
    empty = hits.withColumn("add_ts", F.lit(0).cast("bigint")).where(F.lit(False))
    return upsert.upsert(empty, hits, keys, ["last_modify_ts"])


@query(
    "update_where",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders""",
)
def update_where(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return upsert.update_where(orders, {"o_totalprice": 0, "o_orderstatus": "X"}, "o_orderstatus", "P")


@query("update_affected", """SELECT count(*)::BIGINT AS affected FROM orders WHERE o_orderstatus = 'P'""")
def update_affected(spark, d):
    return upsert.affected(table(spark, d, "orders"), "o_orderstatus", "P")


@query(
    "evolve",
    """SELECT doc_id, lang, 0::BIGINT AS liked_count, '' AS ip_location, n_chars FROM documents""",
)
def evolve(spark, d):
    old = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    schema = StructType.fromDDL("doc_id BIGINT, lang STRING, liked_count BIGINT, ip_location STRING")
    return files.evolve(old, schema, {"liked_count": 0, "ip_location": ""})


@query(
    "append_evolved",
    """SELECT doc_id, lang, 'none' AS source FROM documents WHERE lang = 'fr'
       UNION ALL SELECT doc_id, lang, source FROM documents WHERE lang <> 'fr'""",
)
def append_evolved(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("lang = 'fr'").select("doc_id", "lang")
    new = docs.where("lang <> 'fr'").select("doc_id", "lang", "source")
    return files.append_evolved(old, new, {"source": "none"})


@query(
    "csv_round_trip",
    """SELECT doc_id::VARCHAR AS doc_id, text, lang || ',x"y' AS tags FROM documents""",
)
def csv_round_trip(spark, d):
    """Whole texts with quotes and line breaks, written and read back."""
    path = shared_path(spark, "csv")
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", "text", F.array("lang", F.lit('x"y')).alias("tags"))
    files.sink(rows, "csv", path=path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema("doc_id STRING, text STRING, tags STRING").csv(path)


@query(
    "json_round_trip",
    """SELECT doc_id, text, lang, source, true AS tagged FROM documents""",
)
def json_round_trip(spark, d):
    path = shared_path(spark, "json")
    rows = table(spark, d, "documents").select(
        "doc_id", "text", record(lang=F.col("lang"), source=F.col("source")).alias("origin"),
        F.array("lang").alias("tags"),
    )
    files.sink(rows, "json", path=path)
    back = spark.read.schema(rows.schema).json(path)
    return back.select(
        "doc_id", "text", "origin.lang", "origin.source", (F.element_at("tags", 1) == F.col("origin.lang")).alias("tagged")
    )


@query(
    "output_layout",
    """SELECT event_id, event_type AS role, 'search' AS run_type, ts::DATE AS ingest_date FROM events""",
)
def output_layout(spark, d):
    """Rows appended under platform / run type / role / day folders."""
    path = shared_path(spark, "layout")
    events = table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    rows = files.with_layout(events, "xhs", "search", "contents").withColumns(
        {"role": F.col("event_type"), "ingest_date": F.col("day")}
    )
    files.append_parquet(
        rows.select("event_id", *files.LAYOUT).repartition("role", "ingest_date"), path, partition_by=files.LAYOUT
    )
    return spark.read.parquet(path).select("event_id", "role", "run_type", "ingest_date")


@query("run_ordinal_of_files", """SELECT max(n_regionkey)::BIGINT + 1 AS ordinal FROM nation""")
def run_ordinal_of_files(spark, d):
    """The next run ordinal, from the names of the folders an earlier run wrote."""
    path = shared_path(spark, "runs")
    run = F.concat(F.col("n_regionkey").cast("string"), F.lit("_search_contents"))
    nations = table(spark, d, "nation").select("n_nationkey", run.alias("run"))
    files.append_parquet(nations, path, partition_by=["run"])
    return next_run_ordinal(spark.read.parquet(path), "run")


@query(
    "comments_of_bucketed",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def comments_of_bucketed(spark, d):
    """Contents and comments stored by content id, joined where they lie."""
    tables = {}
    for name, columns in (("orders", ("o_orderkey", "o_custkey")), ("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))):
        path = shared_path(spark, name)
        tables[name] = f"feedloom_{name}_{path[-8:]}"
        files.write_bucketed(table(spark, d, name).select(*columns), tables[name], columns[:1], 8, path)
    content = spark.table(tables["orders"]).withColumnRenamed("o_orderkey", "l_orderkey")
    return comments_of(content, spark.table(tables["lineitem"]), ["l_orderkey"], ["o_custkey"])


# --- media ------------------------------------------------------------------


def _images(df):
    """Part assets: three images, one of them sometimes unusable."""
    return df.withColumn(
        "images",
        F.array(
            text("i0-", F.col("p_partkey")), F.when(F.col("p_size") > 10, text("i1-", F.col("p_partkey"))).otherwise(""),
            text("i2-", F.col("p_partkey")),
        ),
    )


@query(
    "media_xhs",
    """WITH a AS (SELECT p_partkey, 'i0-' || p_partkey AS u, 0 AS n FROM part
         UNION ALL SELECT p_partkey, 'i1-' || p_partkey, 1 FROM part WHERE p_size > 10
         UNION ALL SELECT p_partkey, 'i2-' || p_partkey, CASE WHEN p_size > 10 THEN 2 ELSE 1 END FROM part)
       SELECT p_partkey::VARCHAR AS content_id, n::BIGINT AS ordinal, u AS asset_url,
         p_partkey || '/' || n || '.jpg' AS target_path FROM a
       UNION ALL SELECT p_partkey::VARCHAR, 0, 'v' || p_partkey, p_partkey || '/0.mp4' FROM part WHERE p_size > 25""",
)
def media_xhs(spark, d):
    parts = _images(table(spark, d, "part")).withColumn(
        "videos", F.when(F.col("p_size") > 25, F.array(text("v", F.col("p_partkey"))))
    )
    return media.xhs_manifest(parts, "p_partkey", "images", "videos")


@query(
    "media_dy",
    """SELECT p_partkey::VARCHAR AS content_id, 0::BIGINT AS ordinal, 'i0-' || p_partkey AS asset_url,
         p_partkey || '/000.jpeg' AS target_path FROM part WHERE p_size % 2 = 0
       UNION ALL SELECT p_partkey::VARCHAR, 1, 'i1-' || p_partkey, p_partkey || '/001.jpeg' FROM part
         WHERE p_size % 2 = 0 AND p_size > 10
       UNION ALL SELECT p_partkey::VARCHAR, CASE WHEN p_size > 10 THEN 2 ELSE 1 END, 'i2-' || p_partkey,
         p_partkey || CASE WHEN p_size > 10 THEN '/002.jpeg' ELSE '/001.jpeg' END FROM part WHERE p_size % 2 = 0
       UNION ALL SELECT p_partkey::VARCHAR, 0, 'v' || p_partkey, p_partkey || '/video.mp4' FROM part WHERE p_size % 2 <> 0""",
)
def media_dy(spark, d):
    parts = _images(table(spark, d, "part"))
    images = F.when(F.col("p_size") % 2 == 0, F.col("images"))
    return media.dy_manifest(
        parts.withColumns({"images": images, "video": text("v", F.col("p_partkey"))}), "p_partkey", "images", "video"
    )


@query(
    "media_wb",
    """SELECT p_partkey::VARCHAR AS content_id, 0::BIGINT AS ordinal, 'https://h/x' || p_partkey || '.gif' AS asset_url,
         'pid' || p_partkey || '.gif' AS target_path FROM part""",
)
def media_wb(spark, d):
    pics = F.array(
        record(pid=F.lit("none"), url=F.lit("")),
        record(pid=text("pid", F.col("p_partkey")), url=text("https://h/x", F.col("p_partkey"), ".gif")),
    )
    return media.wb_manifest(table(spark, d, "part").withColumn("pics", pics), "p_partkey", "pics")


@query(
    "media_bili",
    """SELECT p_partkey::VARCHAR AS content_id, 0::BIGINT AS ordinal, 'v' || p_size AS asset_url,
         p_partkey || '/video.mp4' AS target_path FROM part WHERE p_size > 20""",
)
def media_bili(spark, d):
    video = F.when(F.col("p_size") > 20, text("v", F.col("p_size"))).otherwise("")
    return media.bili_manifest(table(spark, d, "part").withColumn("video", video), "p_partkey", "video")
