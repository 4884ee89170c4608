"""Filter and keyword queries."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog.base import query, record, table, text
from feedloom.functions import text as tx
from feedloom.operators import filters as fl
from feedloom.session import spread

KEYWORDS = ["tion", "ung", "oi", "año", "The", "zzz"]
_VALUES = ", ".join(f"('{k}', {i})" for i, k in enumerate(KEYWORDS))


def _cards(spark, d):
    """Events as cards: clicks are posts, every purchase card holds a group of two."""
    def card(kind, i):
        return record(card_type=kind, mblog=record(id=text(F.col("event_id"), f"-{i}")))

    is_post = F.when(F.col("event_type") == "click", 9).otherwise(11)
    group = F.when(
        F.col("event_type").isin("click", "purchase"), F.array(card(F.lit(9), 1), card(F.lit(4), 2))
    )
    return table(spark, d, "events").select(
        "event_id",
        is_post.alias("card_type"),
        record(id=text(F.col("event_id"), "-0")).alias("mblog"),
        group.alias("card_group"),
    )


@query(
    "select_cards",
    """SELECT event_id, 0 AS card_pos, event_id || '-0' AS note_id FROM events WHERE event_type = 'click'
       UNION ALL
       SELECT event_id, 1, event_id || '-1' FROM events WHERE event_type IN ('click', 'purchase')""",
)
def select_cards(spark, d):
    return fl.select_cards(_cards(spark, d)).select(
        "event_id", "card_pos", F.col("mblog.id").alias("note_id")
    )


@query(
    "drop_types",
    """SELECT event_id, nullif(event_type, 'view') AS event_type FROM events
       WHERE event_type NOT IN ('click', 'error')""",
)
def drop_types(spark, d):
    typed = F.nullif("event_type", F.lit("view"))
    events = table(spark, d, "events").select("event_id", typed.alias("event_type"))
    return fl.drop_types(events, "event_type", ["click", "error"])


@query(
    "keep_types",
    """SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')""",
)
def keep_types(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    return fl.keep_types(events, "event_type", ["click", "error"])


@query(
    "route_by_type",
    """SELECT event_id, 'seen' AS what, user_id AS amount, NULL::VARCHAR AS props FROM events WHERE event_type = 'view'
       UNION ALL SELECT event_id, 'paid', event_id, props FROM events WHERE event_type = 'purchase'""",
)
def route_by_type(spark, d):
    routes = {
        "view": [F.col("event_id"), F.lit("seen").alias("what"), F.col("user_id").alias("amount")],
        "purchase": [F.col("event_id"), F.lit("paid").alias("what"), F.col("event_id").alias("amount"), F.col("props")],
    }
    return fl.route_by_type(table(spark, d, "events"), "event_type", routes)


@query(
    "of_kind",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'video' WHEN 'fr' THEN 'normal' ELSE 'answer' END AS content_type
       FROM documents WHERE lang = 'en'
       UNION ALL SELECT doc_id, 'answer' FROM documents WHERE lang NOT IN ('en', 'fr')""",
)
def of_kind(spark, d):
    kind = F.when(F.col("lang") == "en", "video").when(F.col("lang") == "fr", "normal").otherwise("answer")
    docs = table(spark, d, "documents").select("doc_id", kind.alias("content_type"))
    everything = fl.of_kind(docs, "wb", "1")
    return fl.of_kind(everything, "xhs", "1").unionByName(fl.of_kind(docs, "zhihu", "answer"))


@query(
    "in_day_range",
    """SELECT event_id, ts FROM events
       WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""",
)
def in_day_range(spark, d):
    return fl.in_day_range(table(spark, d, "events"), "ts", "2024-01-05", "2024-01-12").select("event_id", "ts")


@query(
    "in_day_range_of_zone",
    """SELECT event_id, ts FROM events
       WHERE ts >= TIMESTAMP '2024-01-04 16:00:00' AND ts < TIMESTAMP '2024-01-12 16:00:00'""",
)
def in_day_range_of_zone(spark, d):
    events = table(spark, d, "events")
    return fl.in_day_range(events, "ts", "2024-01-05", "2024-01-12", "Asia/Shanghai").select("event_id", "ts")


@query(
    "published_within",
    """SELECT o_orderkey, 'three_months' AS span FROM orders
         WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-31' - INTERVAL 3 MONTH AND TIMESTAMP '1997-03-31'
       UNION ALL SELECT o_orderkey, 'one_week' FROM orders
         WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-31' - INTERVAL 7 DAY AND TIMESTAMP '1997-03-31'
       UNION ALL SELECT o_orderkey, '180_days' FROM orders
         WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-31' - INTERVAL 180 DAY AND TIMESTAMP '1997-03-31'
       UNION ALL SELECT o_orderkey, 'unlimited' FROM orders""",
)
def published_within(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    out = None
    windows = {
        "three_months": ("zhihu", "three_months"), "one_week": "one_week", "180_days": ("dy", "180"),
        "unlimited": ("dy", "0"),
    }
    for span, window in windows.items():
        part = fl.published_within(orders, "o_orderdate", window, "1997-03-31 00:00:00")
        part = part.select("o_orderkey", F.lit(span).alias("span"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "drop_empty",
    """SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'error')""",
)
def drop_empty(spark, d):
    key = F.when(F.col("event_type") == "click", "").when(F.col("event_type") != "error", F.col("event_type"))
    return fl.drop_empty(table(spark, d, "events").select("event_id", key.alias("event_type")), "event_type")


@query(
    "with_children",
    """SELECT o_orderkey, n FROM (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)
         ::BIGINT AS n FROM orders) WHERE n > 0""",
)
def with_children(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    counted = table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return fl.with_children(counted, "n")


_REQUESTED = "CASE WHEN l_partkey % 3 = 0 THEN l_orderkey ELSE l_orderkey + 1 END"


def _requested():
    return F.when(F.col("l_partkey") % 3 == 0, F.col("l_orderkey")).otherwise(F.col("l_orderkey") + 1)


@query(
    "consistent_children",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, 'kept' AS fate FROM lineitem WHERE l_orderkey = {_REQUESTED}
        UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'rejected' FROM lineitem
        WHERE l_orderkey <> {_REQUESTED}""",
)
def consistent_children(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    kept, rejected = fl.consistent_children(lines, "l_orderkey", _requested())
    return kept.withColumn("fate", F.lit("kept")).unionByName(rejected.withColumn("fate", F.lit("rejected")))


@query(
    "split_valid",
    """SELECT event_id, CASE WHEN event_type <> 'error' AND user_id > 10 THEN ''
         ELSE array_to_string([CASE WHEN event_type = 'error' THEN 'no_error' END,
                               CASE WHEN user_id <= 10 THEN 'known_user' END], ',') END AS failed
       FROM events""",
)
def split_valid(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "user_id")
    valid, rejected = fl.split_valid(
        events, {"no_error": F.col("event_type") != "error", "known_user": F.col("user_id") > 10}
    )
    return valid.select("event_id", F.lit("").alias("failed")).unionByName(
        rejected.select("event_id", F.array_join("failed_rules", ",").alias("failed"))
    )


@query(
    "conform",
    """SELECT event_id, coalesce(try_cast(CASE WHEN user_id < 50 THEN 'x' ELSE user_id::VARCHAR END AS BIGINT), 0)
         AS total, event_type AS kind, '' AS ip_location FROM events""",
)
def conform(spark, d):
    dirty = F.when(F.col("user_id") < 50, "x").otherwise(F.col("user_id").cast("string"))
    events = table(spark, d, "events").select("event_id", dirty.alias("total"), F.col("event_type").alias("kind"))
    schema = StructType.fromDDL("event_id BIGINT, total BIGINT, kind STRING, ip_location STRING")
    return fl.conform(events, schema, {"total": 0, "ip_location": ""})


@query(
    "keyword_hits_all",
    f"""SELECT doc_id, k AS source_keyword FROM documents, (VALUES {_VALUES}) v(k, i)
        WHERE contains(lower(text), lower(k))""",
)
def keyword_hits_all(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return fl.keyword_search(docs, KEYWORDS, ["text"]).select("doc_id", "source_keyword")


@query(
    "keyword_hits_last",
    f"""SELECT doc_id, arg_max(k, i) AS source_keyword FROM documents, (VALUES {_VALUES}) v(k, i)
        WHERE contains(lower(text), lower(k)) GROUP BY 1""",
)
def keyword_hits_last(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    hits = fl.keyword_search(docs, ",".join(KEYWORDS), ["text"], mode="last")
    return hits.select("doc_id", "source_keyword")


_MANY = [a + b for a in "abcdefghijklmnopqrst" for b in "aeiouhnrst"] + ["The", "tion", "tha"] + [f"No {i}" for i in range(60)]
_MANY_VALUES = ", ".join(f"('{k}', {i})" for i, k in enumerate(_MANY))


def _repeated_documents(spark, d):
    """Documents with repeated and NULL ids."""
    docs = table(spark, d, "documents")
    return spread(docs.select(F.expr("nullif(doc_id % 50, 7)").alias("id"), "text"))


@query(
    "keyword_hits_many",
    f"""SELECT nullif(doc_id % 50, 7) AS id, k AS source_keyword, count(*)::BIGINT AS n
        FROM documents, (VALUES {_MANY_VALUES}) v(k, i)
        WHERE contains(lower(text), lower(k)) GROUP BY 1, 2""",
)
def keyword_hits_many(spark, d):
    """More keywords than are tested in one projection; no column identifies a row."""
    hits = fl.keyword_search(_repeated_documents(spark, d), _MANY, ["text"])
    return hits.groupBy("id", "source_keyword").agg(F.count(F.lit(1)).alias("n"))


@query(
    "keyword_hits_many_last",
    f"""SELECT id, source_keyword, count(*)::BIGINT AS n FROM (
          SELECT doc_id, nullif(any_value(doc_id) % 50, 7) AS id, arg_max(k, i) AS source_keyword
          FROM documents, (VALUES {_MANY_VALUES}) v(k, i)
          WHERE contains(lower(text), lower(k)) GROUP BY 1) GROUP BY 1, 2""",
)
def keyword_hits_many_last(spark, d):
    hits = fl.keyword_search(_repeated_documents(spark, d), _MANY, ["text"], mode="last")
    return hits.groupBy("id", "source_keyword").agg(F.count(F.lit(1)).alias("n"))


_FIRST_WORD = "([^ \\t\\n]+)"
_OWN_WORDS = f"SELECT DISTINCT regexp_extract(text, '{_FIRST_WORD}', 1) AS k FROM benchmark"


@query(
    "keyword_hits_table",
    f"""SELECT doc_id, k AS source_keyword FROM documents, ({_OWN_WORDS}) WHERE k <> ''
        AND contains(lower(text), lower(k))""",
)
def keyword_hits_table(spark, d):
    """Keywords from a table, the first word of every benchmark text: the equi-join on grams."""
    first = F.regexp_extract("text", _FIRST_WORD, 1)
    keywords = table(spark, d, "benchmark").select(first.alias("source_keyword")).where("source_keyword <> ''")
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    hits = fl.keyword_search(docs, keywords.distinct(), ["text"], key=["doc_id"])
    return hits.select("doc_id", "source_keyword")


@query(
    "details_of_url_seeds",
    """SELECT string_split(string_split(url, '?')[1], '/')[-1] AS id, count(*)::BIGINT AS n FROM pages GROUP BY 1""",
)
def details_of_url_seeds(spark, d):
    return table(spark, d, "pages").groupBy(tx.last_segment("url").alias("id")).agg(F.count(F.lit(1)).alias("n"))
