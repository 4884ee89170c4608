"""Reply trees: of rows, and of comments that carry their replies."""

from pyspark.sql import functions as F

from catalog.base import SEEN, landed, query, record, table, text
from feedloom.normalize import canonical, ks, wb, xhs
from feedloom.operators.sets import union_platforms
from feedloom.operators.trees import reply_tree

_WALK = """walk(platform, comment_id, root_id, depth, path) AS (
    SELECT platform, comment_id, comment_id, 1, [comment_id] FROM n
    WHERE parent_comment_id IS NULL OR NOT EXISTS (
      SELECT 1 FROM n p WHERE p.platform = n.platform AND p.comment_id = n.parent_comment_id)
    UNION ALL
    SELECT n.platform, n.comment_id, w.root_id, w.depth + 1, list_append(w.path, n.comment_id)
    FROM n JOIN walk w ON n.platform = w.platform AND n.parent_comment_id = w.comment_id
  )"""


@query(
    "reply_tree_events",
    f"""WITH RECURSIVE given AS (
    SELECT (event_id % 4)::VARCHAR AS platform, event_id AS comment_id,
      CASE WHEN event_id % 101 = 7 THEN -1 - event_id WHEN event_id % 97 = 5 THEN NULL
        WHEN event_id % 103 = 1 THEN event_id + 4 WHEN event_id % 103 = 5 THEN event_id - 4
        ELSE event_id // 12 * 4 + event_id % 4 END AS parent_comment_id
    FROM events
  ), n AS (
    SELECT platform, comment_id, nullif(parent_comment_id, comment_id) AS parent_comment_id FROM given
  ), {_WALK}
  SELECT n.platform, n.comment_id, w.root_id, w.depth::INTEGER AS depth, array_to_string(w.path, '>') AS path,
    n.parent_comment_id IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM n p WHERE p.platform = n.platform AND p.comment_id = n.parent_comment_id) AS orphan
  FROM n LEFT JOIN walk w USING (platform, comment_id)""",
)
def reply_tree_events(spark, d):
    """Events as comments of four platforms: deep chains, missing parents, rings of two."""
    e = F.col("event_id")
    up = (
        F.when(e % 101 == 7, -1 - e)
        .when(e % 97 == 5, F.lit(None))
        .when(e % 103 == 1, e + 4)
        .when(e % 103 == 5, e - 4)
        .otherwise(F.floor(e / 12) * 4 + e % 4)
    )
    rows = table(spark, d, "events").select(
        (e % 4).cast("string").alias("platform"), e.alias("comment_id"), up.cast("bigint").alias("parent_comment_id")
    )
    found = reply_tree(rows, scope=["platform"], no_parent=())
    return found.select("platform", "comment_id", "root_id", "depth", F.array_join("path", ">").alias("path"), "orphan")


_TREES = f"""WITH RECURSIVE n AS (
    SELECT platform, platform || doc_id || r AS comment_id,
      CASE WHEN r = '' THEN NULL WHEN platform <> 'xhs' OR r = '-0' THEN platform || doc_id
        WHEN r = '-4' THEN 'gone' ELSE platform || doc_id || '-' || (substr(r, 2)::INTEGER - 1) END AS parent_comment_id,
      doc_id::VARCHAR AS content_id, lang || r AS body
    FROM documents, (VALUES ('xhs'), ('ks'), ('wb')) p(platform),
      (VALUES (''), ('-0'), ('-1'), ('-2'), ('-3'), ('-4')) k(r) WHERE platform = 'xhs' OR r <> '-4'
  ), {_WALK}
  SELECT n.*, w.root_id, w.depth::INTEGER AS depth, array_to_string(w.path, '>') AS path,
    n.parent_comment_id = 'gone' IS TRUE AS orphan
  FROM n LEFT JOIN walk w USING (platform, comment_id)"""


@query("reply_tree_comments", _TREES)
def reply_tree_comments(spark, d):
    """Comments with replies inside, of three platforms, through their normalisers into
    canonical comments and one forest. A reply of xhs names what it answers."""
    docs = table(spark, d, "documents").withColumn("requested_id", F.col("doc_id"))
    own = F.col("doc_id").cast("string")
    numbers = F.array(*map(F.lit, range(5)))

    def reply(platform, n):
        return text(platform, own, "-", n)

    def body(n=None):
        return text(F.col("lang")) if n is None else text(F.col("lang"), "-", n)

    target = lambda n: F.when(n == 4, F.lit("gone")).when(n > 0, reply("xhs", n - 1))
    answers = F.transform(numbers, lambda n: record(id=reply("xhs", n), content=body(n), target_comment=record(id=target(n))))
    trees = {
        "xhs": landed(docs, "requested_id", id=text("xhs", own), content=body(), sub_comments=answers),
        "ks": landed(
            docs, "requested_id", commentId=text("ks", own), content=body(),
            subComments=F.transform(F.slice(numbers, 1, 4), lambda n: record(commentId=reply("ks", n), content=body(n))),
        ),
        "wb": landed(
            docs, "requested_id", id=text("wb", own), text=body(),
            comments=F.transform(
                F.slice(numbers, 1, 4),
                lambda n: record(id=reply("wb", n), text=body(n), rootid=F.when(n % 2 == 0, text("wb", own))),
            ),
        ),
    }
    normalise = {"xhs": xhs, "ks": ks, "wb": wb}
    comments = union_platforms(
        *(canonical.canonical_comment(normalise[p].normalize_comment_tree(t, SEEN), p) for p, t in trees.items())
    )
    found = reply_tree(comments)
    return found.select(
        "platform", "comment_id", "parent_comment_id", "content_id", "body", "root_id", "depth",
        F.array_join("path", ">").alias("path"), "orphan",
    )
