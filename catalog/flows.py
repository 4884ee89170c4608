"""Whole flows: search, creator, detail."""

from pyspark.sql import functions as F

from catalog.base import query, record, table, text
from catalog.normalize import state_page
from feedloom.plans.creator import CreatorCaps, creator_run
from feedloom.plans.detail import detail_run, zhihu_details
from feedloom.plans.search import SearchCaps, search
from feedloom.session import spread

_HITS = """h AS (SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) AS rn
    FROM documents, (VALUES ('tion'), ('ung'), ('oi')) v(k) WHERE contains(lower(text), k))"""
_KEPT = """c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
    FROM conversations WHERE conv_id IN (SELECT doc_id FROM h WHERE rn <= 40))"""


def _search(spark, d):
    """Documents as contents, conversation turns as their comments."""
    content = spread(table(spark, d, "documents").select("doc_id", "text", "n_chars")).select(
        F.lit("x").alias("platform"), F.col("doc_id").alias("content_id"), F.col("text").alias("body"), "n_chars"
    )
    comment = table(spark, d, "conversations").select(
        F.lit("x").alias("platform"), F.col("conv_id").alias("content_id"), F.col("turn").alias("comment_id"),
        F.lit(None).cast("string").alias("parent_comment_id"), F.col("text").alias("body"),
    )
    return search(
        content, comment, "tion,ung,oi", ["body"], order=[F.desc("n_chars"), F.col("content_id")],
        comment_order=[F.col("comment_id")], stop=["the", "de"],
        caps=SearchCaps(contents_per_keyword=50, comments_per_content=3),
    )


@query(
    "search_contents",
    f"""WITH {_HITS} SELECT k AS source_keyword, doc_id AS content_id, ceil(rn / 20.0)::BIGINT AS page FROM h WHERE rn <= 40""",
)
def search_contents(spark, d):
    return _search(spark, d).content.select("source_keyword", "content_id", "page")


@query(
    "search_comments",
    f"""WITH {_HITS}, {_KEPT} SELECT conv_id AS content_id, turn AS comment_id FROM c WHERE rn <= 3""",
)
def search_comments(spark, d):
    return _search(spark, d).comment.select("content_id", "comment_id")


@query(
    "search_words",
    rf"""WITH {_HITS}, {_KEPT} SELECT word, count(*)::BIGINT AS n FROM (
           SELECT unnest(regexp_extract_all(text, '([\p{{L}}\p{{N}}]+)', 1)) AS word FROM c WHERE rn <= 3)
         WHERE word NOT IN ('the', 'de') GROUP BY 1""",
)
def search_words(spark, d):
    return _search(spark, d).words


def _turns(spark, d):
    """Conversation turns as comments: every third one opens, the next two answer in a chain."""
    turn = F.col("turn")
    return table(spark, d, "conversations").select(
        F.lit("x").alias("platform"), F.col("conv_id").alias("content_id"), turn.alias("comment_id"),
        F.when(turn % 3 > 0, turn - 1).alias("parent_comment_id"), F.col("text").alias("body"),
        F.timestamp_seconds(turn).alias("created_ts"),
    )


_OPEN = """o AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
    FROM conversations WHERE turn % 3 = 0),
  r AS (SELECT c.conv_id, c.turn, c.text, c.turn // 3 * 3 AS root, c.turn % 3 + 1 AS depth FROM conversations c
    WHERE c.turn % 3 > 0 AND EXISTS (SELECT 1 FROM o WHERE o.conv_id = c.conv_id AND o.turn = c.turn // 3 * 3 AND rn <= 2)
      AND (c.turn % 3 = 1 OR EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)))"""


@query(
    "search_replies",
    f"""WITH {_HITS}, {_OPEN} SELECT conv_id AS content_id, turn AS comment_id, root AS root_id, depth::INTEGER AS depth
       FROM r WHERE conv_id IN (SELECT doc_id FROM h WHERE rn <= 40)""",
)
def search_replies(spark, d):
    """What answers the kept comments of a search, and how deep."""
    content = spread(table(spark, d, "documents").select("doc_id", "text", "n_chars")).select(
        F.lit("x").alias("platform"), F.col("doc_id").alias("content_id"), F.col("text").alias("body"), "n_chars"
    )
    found = search(
        content, _turns(spark, d), "tion,ung,oi", ["body"], order=[F.desc("n_chars"), F.col("content_id")],
        caps=SearchCaps(contents_per_keyword=50, comments_per_content=2, replies=True),
    )
    return found.replies.select("content_id", "comment_id", "root_id", "depth")


@query(
    "search_days",
    """WITH h AS (SELECT k, event_id, ts, row_number() OVER (PARTITION BY k, ts::DATE ORDER BY value DESC, event_id) AS rn
         FROM events, (VALUES ('click'), ('view')) v(k) WHERE contains(lower(event_type), k)
         AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00')
       SELECT source_keyword, content_id FROM (SELECT k AS source_keyword, event_id AS content_id,
         row_number() OVER (PARTITION BY k ORDER BY ts::DATE, value, event_id) AS n FROM (
           SELECT h.*, -e.value AS value FROM h JOIN events e USING (event_id)) WHERE rn <= 3) WHERE n <= 20""",
)
def search_days(spark, d):
    """A search by days: three contents a day, twenty a keyword."""
    content = table(spark, d, "events").select(
        F.lit("x").alias("platform"), F.col("event_id").alias("content_id"), F.col("event_type").alias("body"),
        F.col("ts").alias("created_ts"), "value",
    )
    caps = SearchCaps(contents_per_keyword=20, days=("2024-01-03", "2024-01-10"), contents_per_day=3)
    none = _turns(spark, d)
    found = search(content, none, "click,view", ["body"], order=[F.desc("value"), F.col("content_id")], caps=caps)
    return found.content.select("source_keyword", "content_id")


@query(
    "detail_run_words",
    rf"""WITH {_OPEN}, t AS (
         SELECT conv_id, text FROM o WHERE rn <= 2 UNION ALL SELECT conv_id, text FROM r)
       SELECT word, count(*)::BIGINT AS n FROM (
         SELECT unnest(regexp_extract_all(text, '([\p{{L}}\p{{N}}]+)', 1)) AS word FROM t
         WHERE conv_id % 3 = 0 AND conv_id IN (SELECT doc_id FROM documents)) WHERE word <> 'the' GROUP BY 1""",
)
def detail_run_words(spark, d):
    """Contents by id, their comments with replies, and the words of both."""
    return _detail_run(spark, d).discussion.words


@query("detail_run_not_found", "SELECT 'x' AS platform, doc_id + 1000000000 AS content_id FROM documents WHERE doc_id % 3 = 0")
def detail_run_not_found(spark, d):
    return _detail_run(spark, d).not_found


def _detail_run(spark, d):
    docs = table(spark, d, "documents").select(F.lit("x").alias("platform"), F.col("doc_id").alias("content_id"), "text")
    third = docs.where("content_id % 3 = 0").select("platform", "content_id")
    seeds = third.unionByName(third.withColumn("content_id", F.col("content_id") + 1000000000))
    return detail_run(seeds, docs, _turns(spark, d), comments_per_content=2, replies=True, stop=["the"])


@query(
    "creator_comments",
    """WITH mine AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (
         PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders
         WHERE o_custkey IN (SELECT c_custkey * 2 FROM customer)) WHERE rn <= 4)
       SELECT l_orderkey AS content_id, l_linenumber AS comment_id FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem
         WHERE l_orderkey IN (SELECT o_orderkey FROM mine)) WHERE rn <= 2""",
)
def creator_comments(spark, d):
    """Comments of the contents of the seeds, and the seeds' profiles beside them."""
    seeds = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("author_id"))
    content = table(spark, d, "orders").select(
        F.lit("x").alias("platform"), F.col("o_orderkey").alias("content_id"), F.col("o_custkey").alias("author_id"),
        F.col("o_orderdate").alias("created_ts"),
    )
    comment = table(spark, d, "lineitem").select(
        F.lit("x").alias("platform"), F.col("l_orderkey").alias("content_id"), F.col("l_linenumber").alias("comment_id"),
        F.lit(None).cast("int").alias("parent_comment_id"), F.col("l_returnflag").alias("body"),
        F.timestamp_seconds("l_linenumber").alias("created_ts"),
    )
    caps = CreatorCaps(contents=4, comments_per_content=2)
    found = creator_run(seeds, content, caps=caps, comment=comment)
    return found.discussion.comment.select("content_id", "comment_id")


@query(
    "creator_profiles",
    """SELECT c_custkey AS user_id, c_name AS name FROM customer
       WHERE c_custkey IN (SELECT c_custkey * 2 FROM customer)""",
)
def creator_profiles(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    seeds = customers.select((F.col("user_id") * 2).alias("author_id"))
    content = table(spark, d, "orders").select(
        F.lit("x").alias("platform"), F.col("o_orderkey").alias("content_id"), F.col("o_custkey").alias("author_id"),
        F.col("o_orderdate").alias("created_ts"),
    )
    return creator_run(seeds, content, creator=customers).creator


def _creator(spark, d):
    seeds = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("author_id"))
    content = table(spark, d, "orders").select(
        F.lit("x").alias("platform"), F.col("o_orderkey").alias("content_id"), F.col("o_custkey").alias("author_id"),
        F.col("o_orderdate").alias("created_ts"),
    )
    lines = table(spark, d, "lineitem")
    fans = lines.select(F.col("l_suppkey").alias("up_id"), F.col("l_partkey").alias("fan_id")).distinct()
    followings = lines.select(F.col("l_partkey").alias("up_id"), F.col("l_suppkey").alias("fan_id")).distinct()
    activity = table(spark, d, "events").select(
        F.col("event_id").alias("activity_id"), "user_id", F.col("ts").alias("pub_ts"), "event_type"
    )
    return creator_run(seeds, content, fans, followings, activity, CreatorCaps(contents=4, contacts=10, activities=5))


@query(
    "creator_contents",
    """SELECT author_id, content_id FROM (SELECT o_custkey AS author_id, o_orderkey AS content_id, row_number() OVER (
         PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders
         WHERE o_custkey IN (SELECT c_custkey * 2 FROM customer)) WHERE rn <= 4""",
)
def creator_contents(spark, d):
    return _creator(spark, d).content.select("author_id", "content_id")


@query(
    "creators_not_found",
    """SELECT DISTINCT c_custkey * 2 AS author_id FROM customer
       WHERE c_custkey * 2 NOT IN (SELECT o_custkey FROM orders)""",
)
def creators_not_found(spark, d):
    return _creator(spark, d).not_found


@query(
    "creator_edges",
    """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem
         WHERE l_suppkey IN (SELECT c_custkey * 2 FROM customer)),
       r AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) AS rn FROM e)
       SELECT s AS up_id, p AS fan_id FROM r WHERE rn <= 10 UNION SELECT p, s FROM r WHERE rn <= 10""",
)
def creator_edges(spark, d):
    return _creator(spark, d).edges


@query(
    "creator_activity",
    """SELECT user_id, activity_id, event_type FROM (SELECT user_id, event_id AS activity_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events
         WHERE user_id IN (SELECT c_custkey * 2 FROM customer)) WHERE rn <= 5""",
)
def creator_activity(spark, d):
    return _creator(spark, d).activity.select("user_id", "activity_id", "event_type")


def _details(spark, d):
    """A seed URL per document; every fifth document's page was never landed."""
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "/question/1/answer/").otherwise("/p/")
    url = text("https://www.zhihu.com", kind, F.col("doc_id"))
    answer = record(
        id=F.col("doc_id"), type=F.lit("answer"), title=F.col("lang"), voteupCount=F.col("n_chars"),
        question=record(id=F.lit("1")), content=text("<p>", F.col("text"), "</p>"),
    )
    article = record(
        id=F.col("doc_id"), type=F.lit("article"), title=F.col("lang"), voteupCount=F.col("n_chars"),
        content=text("<p>", F.col("text"), "</p>"),
    )
    key = F.col("doc_id").cast("string")
    is_answer = F.col("doc_id") % 2 == 0
    entities = record(
        answers=F.when(is_answer, F.create_map(key, answer)), articles=F.when(~is_answer, F.create_map(key, article))
    )
    pages = spread(docs.where("doc_id % 5 <> 0")).select(url.alias("url"), state_page(entities).alias("html"))
    seeds = docs.select(text(url, "?from=feed").alias("url"))
    return zhihu_details(seeds, pages)


@query(
    "detail_contents",
    r"""SELECT doc_id::VARCHAR AS content_id, CASE WHEN doc_id % 2 = 0 THEN 'answer' ELSE 'article' END AS content_type,
         lang AS title, n_chars AS voteup_count,
         regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS content_text
       FROM documents WHERE doc_id % 5 <> 0""",
)
def detail_contents(spark, d):
    return _details(spark, d).content.select("content_id", "content_type", "title", "voteup_count", "content_text")


@query(
    "details_not_found",
    """SELECT 'https://www.zhihu.com' || CASE WHEN doc_id % 2 = 0 THEN '/question/1/answer/' ELSE '/p/' END || doc_id
         || '?from=feed' AS url FROM documents WHERE doc_id % 5 = 0""",
)
def details_not_found(spark, d):
    return _details(spark, d).not_found
