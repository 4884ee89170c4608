"""Streaming queries. Each runs the stream to the end of the files there and gives the
rows it wrote; the SQL is that of the batch twin."""

from pyspark.sql import functions as F

from catalog.base import landed, query, record, table, text
from catalog.sources import LINKS
from feedloom.normalize import xhs
from feedloom.operators.filters import keyword_search
from feedloom.operators.ranking import latest
from feedloom.session import ROCKSDB_PROVIDER, shared_path
from feedloom.sinks import buckets, upsert
from feedloom.sinks.files import append_parquet
from feedloom.sources.pages import parse_html
from feedloom.streaming import ingest, state


def _stream(spark, d, name, at_once=False):
    """The table's files as a stream, one a micro-batch or all at once: one file or a folder of parts."""
    rows = table(spark, d, name)
    file = f"{name}.parquet"
    pace = None if at_once else 1
    if any(not f.rstrip("/").endswith(f"/{file}") for f in rows.inputFiles()):
        return ingest.read_stream(spark, f"{d}/{file}", rows.schema, files_per_trigger=pace)
    return ingest.read_stream(spark, d, rows.schema, files_per_trigger=pace, pathGlobFilter=file)


def _landed(spark, stream, mode, name):
    """Run a stream to its end; every micro-batch goes to its own folder."""
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-progress")

    def write(batch, batch_id):
        append_parquet(batch.withColumn("batch_id", F.lit(batch_id)), f"{out}/batch={batch_id}", "overwrite")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode)
    with ingest.no_empty_batches(spark):
        run = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(out).drop("batch")


def _rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    return spark


@query(
    "stream_ingest",
    """SELECT event_id, event_type, 0::BIGINT AS batch_id FROM events WHERE event_type <> 'error'""",
)
def stream_ingest(spark, d):
    """Every micro-batch is handed to a function, here one that filters and appends."""
    out = shared_path(spark, "ingest")

    def keep(batch, batch_id):
        rows = batch.where("event_type <> 'error'").select("event_id", "event_type", F.lit(batch_id).alias("batch_id"))
        append_parquet(rows, f"{out}/batch={batch_id}", "overwrite")

    ingest.stream_ingest(_stream(spark, d, "events", at_once=True), keep, shared_path(spark, "ingest-progress")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "event_type", F.col("batch_id").cast("bigint").alias("batch_id"))


@query(
    "stream_normalize",
    """SELECT 'n' || doc_id AS note_id, left(text, 255) AS title, text AS "desc", n_chars::VARCHAR AS liked_count,
         lang AS source_keyword FROM documents WHERE contains(lower(text), lang)""",
)
def stream_normalize(spark, d):
    """Landed notes are normalised and searched while they arrive."""
    payload = landed(
        _stream(spark, d, "documents"), "lang", note_id=text("n", F.col("doc_id")), desc=F.col("text"),
        interact_info=record(liked_count=F.col("n_chars").cast("string")),
    )
    notes = xhs.normalize_note(payload.withColumnRenamed("lang", "source_keyword"))
    found = keyword_search(notes.withColumnRenamed("source_keyword", "lang"), ["en", "fr", "de", "es"], ["desc"])
    own = found.where(F.col("source_keyword") == F.col("lang"))
    rows = own.select("note_id", "title", "desc", "liked_count", "source_keyword")
    return _landed(spark, rows, "append", "notes").drop("batch_id")


@query(
    "stream_html_records",
    r"""SELECT page_id, unnest(range(len(h))) AS record_pos, unnest(h) AS href FROM (
         SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h FROM pages)""",
)
def stream_html_records(spark, d):
    links = parse_html(_stream(spark, d, "pages").select("page_id", "html"), LINKS)
    return _landed(spark, links, "append", "links").select("page_id", "record_pos", "href")


_KEYS, _ORDER = ["user_id", "event_type"], ["last_modify_ts", "event_id"]


@query(
    "stream_upsert",
    """SELECT user_id, event_type, arg_max(props, (ts, event_id)) AS props, max(event_id) AS event_id,
         epoch_us(max(ts)) // 1000 AS last_modify_ts, epoch_us(min(ts)) // 1000 AS add_ts FROM events GROUP BY 1, 2""",
)
def stream_upsert(spark, d):
    path = shared_path(spark, "stream-upsert")
    rows = _stream(spark, d, "events").select(
        "user_id", "event_type", "props", "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("last_modify_ts"),
    )
    run = ingest.stream_upsert(rows, path, _KEYS, _ORDER, shared_path(spark, "stream-upsert-progress"))
    run.awaitTermination()
    return upsert.read_upserts(spark, path, _KEYS, _ORDER)


@query(
    "stream_dedupe",
    """SELECT DISTINCT user_id, event_type FROM events""",
)
def stream_dedupe(spark, d):
    """Repeats within 60 days are ignored, which covers the whole table."""
    once = ingest.stream_dedupe(_stream(spark, d, "events"), ["user_id", "event_type"], "ts", "60 days")
    return _landed(spark, once.select("user_id", "event_type"), "append", "dedupe").drop("batch_id")


@query(
    "stream_word_freq",
    r"""SELECT word, count(*)::BIGINT AS n FROM (
          SELECT unnest(regexp_extract_all(text, '([\p{L}\p{N}]+)', 1)) AS word FROM conversations)
        WHERE word NOT IN ('the', 'de') GROUP BY 1""",
)
def stream_word_freq(spark, d):
    counts = ingest.stream_word_freq(_stream(spark, d, "conversations"), "text", ["the", "de"])
    rows = _landed(spark, counts, "update", "words")
    return latest(rows, ["word"], [F.desc("batch_id")]).select("word", "n")


@query(
    "stream_daily_counts",
    """SELECT ts::DATE AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""",
)
def stream_daily_counts(spark, d):
    counts = ingest.stream_daily_counts(_stream(spark, d, "events"), "ts", ["event_type"])
    rows = _landed(spark, counts, "update", "days")
    return latest(rows, ["day", "event_type"], [F.desc("batch_id")]).select("day", "event_type", "n")


@query(
    "stream_first_n",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
       FROM events) WHERE rn <= 3""",
)
def stream_first_n(spark, d):
    events = _stream(_rocksdb(spark), d, "events").select("user_id", "event_id", "ts")
    capped = state.stream_first_n(events, ["user_id"], ["ts", "event_id"], 3)
    return _landed(spark, capped, "append", "first").select("user_id", "event_id")


@query(
    "expiring_state",
    """SELECT user_id, arg_max(props, (ts, event_id)) AS props, max(event_id) AS event_id, NULL::VARCHAR AS previous
       FROM events GROUP BY 1""",
)
def expiring_state(spark, d):
    events = _stream(_rocksdb(spark), d, "events", at_once=True).select("user_id", "props", "event_id")
    held = state.expiring_state(events, ["user_id"], "props", ["event_id"], 3600)
    return _landed(spark, held, "update", "held").select("user_id", "props", "event_id", "previous")


# --- tables that arrive in four parts ----------------------------------------
#
# Each part is landed and the stream run to its end before the next one lands, with one
# checkpoint: four micro-batches, a restart before each but the first.

_PARTS = 4
_PART = """(CASE WHEN ts < TIMESTAMP '2024-01-08 00:00:00' THEN 0 WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 1
  WHEN ts < TIMESTAMP '2024-01-22 00:00:00' THEN 2 ELSE 3 END)"""


def _part():
    """The week of January 2024 that an event belongs to."""
    weeks = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / (7 * 86400))
    return F.least(F.greatest(weeks, F.lit(0)), F.lit(_PARTS - 1))


def _arriving(spark, d, name, make, part=None):
    """Run ``make(stream, out, checkpoint)`` over the table, part by part; the output path
    and the checkpoint."""
    rows = table(spark, d, name).withColumn("_part", _part() if part is None else part)
    source, out, checkpoint = (shared_path(spark, f"{name}-{kind}") for kind in ("parts", "out", "progress"))
    schema = rows.drop("_part").schema
    for k in range(_PARTS):
        rows.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(source)
        with ingest.no_empty_batches(spark):
            run = make(ingest.read_stream(spark, source, schema), out, checkpoint)
        run.awaitTermination()
    return out, checkpoint


def _batches(spark, d, name, make, mode, part=None):
    """The rows that a stream operator emits, and the micro-batch of each."""
    schemas = []

    def start(stream, out, checkpoint):
        rows = make(stream)
        schemas.append(rows.schema)

        def write(batch, batch_id):
            append_parquet(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), f"{out}/batch={batch_id}", "overwrite")

        writer = rows.writeStream.foreachBatch(write).outputMode(mode)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    out, _ = _arriving(spark, d, name, start, part)
    return spark.read.schema(schemas[0].add("batch_id", "long")).parquet(out).drop("batch")


@query("stream_ingest_parts", f"SELECT event_id, event_type, {_PART}::BIGINT AS batch_id FROM events WHERE event_type <> 'error'")
def stream_ingest_parts(spark, d):
    """The batch that handed over each row."""
    rows = _batches(spark, d, "events", lambda s: s.where("event_type <> 'error'").select("event_id", "event_type"), "append")
    return rows.select("event_id", "event_type", "batch_id")


_LAST_PART = f"""SELECT user_id, event_type, arg_max(props, (ts, event_id)) AS props, max(event_id) AS event_id,
    epoch_us(max(ts)) // 1000 AS last_modify_ts, epoch_us(min(ts)) // 1000 AS add_ts FROM events GROUP BY 1, 2"""


def _updates(stream):
    return stream.select(
        "user_id", "event_type", "props", "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("last_modify_ts"),
    )


@query("stream_upsert_parts", _LAST_PART)
def stream_upsert_parts(spark, d):
    """Merged on read: four batches of one run."""
    out, _ = _arriving(
        spark, d, "events", lambda s, out, progress: ingest.stream_upsert(_updates(s), out, _KEYS, _ORDER, progress)
    )
    return upsert.read_upserts(spark, out, _KEYS, _ORDER)


@query("stream_upsert_buckets", _LAST_PART)
def stream_upsert_buckets(spark, d):
    """Copied on write, bucket by bucket: four commits."""
    out, _ = _arriving(
        spark, d, "events",
        lambda s, out, progress: ingest.stream_upsert_buckets(_updates(s), out, _KEYS, _ORDER, progress, buckets=16),
    )
    return buckets.read_buckets(spark, out)


@query(
    "stream_dedupe_parts",
    f"""SELECT user_id, event_type, min({_PART})::BIGINT AS batch_id FROM events GROUP BY 1, 2""",
)
def stream_dedupe_parts(spark, d):
    """The micro-batch that passed each pair first; hot keys in pieces."""
    once = lambda s: ingest.stream_dedupe(s, ["user_id", "event_type"], "ts", "60 days", salts=4).select("user_id", "event_type")
    return _batches(spark, d, "events", once, "append")


@query(
    "stream_word_freq_parts",
    r"""WITH w AS (
      SELECT conv_id % 4 AS part, unnest(regexp_extract_all(text, '([\p{L}\p{N}]+)', 1)) AS word FROM conversations
    ), n AS (SELECT word, part, count(*) AS n FROM w WHERE word NOT IN ('the', 'de') GROUP BY 1, 2)
    SELECT word, part::BIGINT AS batch_id, (sum(n) OVER (PARTITION BY word ORDER BY part))::BIGINT AS n FROM n""",
)
def stream_word_freq_parts(spark, d):
    """The running count of a word after each micro-batch that holds it."""
    counts = lambda s: ingest.stream_word_freq(s, "text", ["the", "de"])
    return _batches(spark, d, "conversations", counts, "update", F.col("conv_id") % 4)


@query(
    "stream_daily_counts_parts",
    f"""SELECT ts::DATE AS day, event_type, {_PART}::BIGINT AS batch_id, count(*)::BIGINT AS n FROM events GROUP BY 1, 2, 3""",
)
def stream_daily_counts_parts(spark, d):
    """Each day lies in one part, so it is counted in one micro-batch."""
    return _batches(spark, d, "events", lambda s: ingest.stream_daily_counts(s, "ts", ["event_type"]), "update")


@query(
    "stream_first_n_parts",
    f"""SELECT user_id, event_id, {_PART}::BIGINT AS batch_id FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 3""",
)
def stream_first_n_parts(spark, d):
    """The cap holds across micro-batches and restarts."""
    capped = lambda s: state.stream_first_n(s.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 3)
    return _batches(_rocksdb(spark), d, "events", capped, "append").select("user_id", "event_id", "batch_id")


_SETS = f"""s AS (
    SELECT user_id, part, arg_max(props, (ts, event_id)) AS props, max(ts) AS ts, epoch_us(max(ts)) // 1000 AS t
    FROM (SELECT *, {_PART} AS part FROM events) GROUP BY 1, 2
  ), w AS (
    SELECT *, lag(props) OVER k AS before, lag(t) OVER k AS t_before, lead(t) OVER k AS t_next FROM s
    WINDOW k AS (PARTITION BY user_id ORDER BY part))"""


@query(
    "expiring_state_parts",
    f"""WITH {_SETS} SELECT user_id, props, before AS previous, part::BIGINT AS batch_id FROM w""",
)
def expiring_state_parts(spark, d):
    """What each micro-batch set, and what was held before: no value runs out within the run."""
    def held(s):
        rows = s.select("user_id", "props", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
        return state.expiring_state(rows, ["user_id"], "props", ["t", "event_id"], 3600)

    return _batches(_rocksdb(spark), d, "events", held, "update").select("user_id", "props", "previous", "batch_id")


_TTL = 5 * 86400


@query(
    "sweeping_state",
    f"""WITH {_SETS}, mark AS (SELECT max(t) AS m FROM s WHERE part < 3)
    SELECT user_id, props, CASE WHEN t_before + {_TTL * 1000} > t THEN before END AS previous, 'set' AS event, t AS at FROM w
    UNION ALL
    SELECT user_id, props, NULL, 'expired', t + {_TTL * 1000} FROM w, mark
    WHERE CASE WHEN t_next IS NULL THEN t + {_TTL * 1000} < m AND EXISTS (SELECT 1 FROM s WHERE part = 3)
      ELSE t + {_TTL * 1000} <= t_next END""",
)
def sweeping_state(spark, d):
    """Values of five days by event time: each set, with what was held, and each end."""
    def held(s):
        return state.sweeping_state(s, ["user_id"], "props", "ts", _TTL, order=["event_id"])

    rows = _batches(_rocksdb(spark), d, "events", held, "update")
    return rows.select("user_id", "props", "previous", "event", "at")


@query(
    "held_keys",
    f"""WITH s AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1)
    SELECT user_id FROM s WHERE contains(user_id::VARCHAR, '1') AND (ts >= TIMESTAMP '2024-01-22 00:00:00'
      OR epoch_us(ts) // 1000 + {_TTL * 1000} >= (SELECT epoch_us(max(ts)) // 1000 FROM events WHERE ts < TIMESTAMP '2024-01-22 00:00:00'))""",
)
def held_keys(spark, d):
    """The keys with a 1 that are still held after the last micro-batch."""
    def start(s, out, checkpoint):
        rows = state.sweeping_state(s, ["user_id"], "props", "ts", _TTL, order=["event_id"])
        writer = rows.writeStream.foreachBatch(lambda batch, _: batch.write.format("noop").mode("overwrite").save())
        return writer.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    _, checkpoint = _arriving(_rocksdb(spark), d, "events", start)
    return state.held_keys(spark, checkpoint, "*1*").select(F.col("key.user_id").alias("user_id"))
