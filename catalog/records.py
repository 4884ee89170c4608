"""Records of drifting shape: valid rows and the quarantine, written in one pass."""

from pyspark.sql import functions as F

from catalog.base import query, table, text
from catalog.normalize import tieba_search
from feedloom.operators import records as rec
from feedloom.session import shared_path

# Four shapes of one record, texts that are no JSON, and empty ones.
_KIND = "event_id % 11"
_FIELDS = {
    "id": rec.Field("bigint", ("$.id", "$.old.id"), required=True),
    "kind": rec.Field("string", "$.kind", required=True),
    "score": rec.Field("double", "$.stat.score", default=0.5),
    "tags": rec.Field("array<string>", "$.tags"),
}


def _landed(spark, d):
    """Written once; both queries below read their part of it."""
    e = F.col("event_id")
    kind = text('"kind":"', F.col("event_type"), '"')
    shape = e % 11
    payload = (
        F.when(shape == 0, text('{"id":', e, ",", kind, ',"stat":{"score":1.5},"tags":["a","b,c"]}'))
        .when(shape == 1, text('{"id":"', e, '",', kind, ',"stat":{"score":"2.25"},"new":[1]}'))
        .when(shape == 2, text('{"old":{"id":', e, "},", kind, ',"stat":{"score":null},"tags":null}'))
        .when(shape == 3, text('{"id":', e, ',"kind":"  "}'))
        .when(shape == 4, text("{", kind, ',"stat":{"score":"many"}}'))
        .when(shape == 5, text('{"id":"x', e, '",', kind, ',"tags":["z"]}'))
        .when(shape == 6, text('{"id":', e, ',"kind"'))
        .when(shape == 7, F.lit(" "))
        .when(shape == 8, F.lit(None).cast("string"))
        .otherwise(text('{"id":', e, ",", kind, ',"stat":7}'))
    )
    path = shared_path(spark, "checked")
    rows = table(spark, d, "events").select("event_id", payload.alias("payload"))
    rec.land_checked(rec.check_records(rows, _FIELDS), path)
    return path


@query(
    "records_valid",
    f"""SELECT event_id, event_id AS id, event_type AS kind, CASE {_KIND} WHEN 0 THEN 1.5 WHEN 1 THEN 2.25 ELSE 0.5 END::DOUBLE AS score,
      CASE {_KIND} WHEN 0 THEN 'a|b,c' END AS tags FROM events WHERE {_KIND} NOT IN (3, 4, 5, 6, 7, 8)""",
)
def records_valid(spark, d):
    """Fields by name and type, wherever a record's shape has them."""
    rows = rec.read_valid(spark, _landed(spark, d)).drop("payload")
    return rows.withColumn("tags", F.array_join("tags", "|"))


@query(
    "records_quarantine",
    f"""SELECT event_id, CASE {_KIND} WHEN 3 THEN '{{"id":' || event_id || ',"kind":"  "}}'
        WHEN 4 THEN '{{"kind":"' || event_type || '","stat":{{"score":"many"}}}}'
        WHEN 5 THEN '{{"id":"x' || event_id || '","kind":"' || event_type || '","tags":["z"]}}'
        WHEN 6 THEN '{{"id":' || event_id || ',"kind"' WHEN 7 THEN ' ' END AS payload,
      CASE {_KIND} WHEN 3 THEN 'missing:kind' WHEN 4 THEN 'missing:id,type:score' WHEN 5 THEN 'type:id'
        WHEN 6 THEN 'not json' ELSE 'empty' END AS problems
      FROM events WHERE {_KIND} IN (3, 4, 5, 6, 7, 8)""",
)
def records_quarantine(spark, d):
    """The rejected texts as they came, and why."""
    found = rec.read_quarantine(spark, _landed(spark, d), ["event_id", "payload"])
    return found.withColumn("problems", F.array_join("problems", ","))


@query(
    "tieba_quarantine",
    """SELECT '' AS forum, 'missing:note_id,missing:title,missing:tieba_name' AS problems, count(*)::BIGINT AS n
       FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0
       UNION ALL SELECT 'bar' || o_orderstatus, '', count(*) FROM orders GROUP BY 1""",
)
def tieba_quarantine(spark, d):
    """Search results of pages: blocks without an id, a title or a forum are no notes."""
    path = shared_path(spark, "tieba-checked")
    notes = tieba_search.__wrapped__(spark, d)
    rec.land_checked(rec.check_columns(notes, rec.TIEBA_REQUIRED["note"]), path)
    forum = F.col("tieba_name").alias("forum")
    bad = rec.read_quarantine(spark, path, ["tieba_name"]).select(forum, F.array_join("problems", ",").alias("problems"))
    good = rec.read_valid(spark, path).select(forum, F.lit("").alias("problems"))
    return bad.unionByName(good).groupBy("forum", "problems").agg(F.count("*").alias("n"))
