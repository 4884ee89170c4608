"""Word counts, latest values, pivots and other aggregates."""

from pyspark.sql import functions as F

from catalog.base import query, table
from feedloom.functions import nested
from feedloom.functions import text as tx
from feedloom.operators import aggregates as ag
from feedloom.operators import words as wd
from feedloom.session import spread

STOP = ["the", "de", "la", "and", "of", "le", "und", "der"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
PAGE_TEXT = (
    "regexp_replace(regexp_replace(regexp_replace(html, "
    "'<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gs'), '<[^>]+>', '', 'g'), "
    r"'^\s+|\s+$', '', 'g')"
)


@query(
    "top_words",
    rf"""SELECT word, count(*)::BIGINT AS n FROM (
          SELECT unnest(regexp_extract_all({PAGE_TEXT}, '([\p{{L}}\p{{N}}]+)', 1)) AS word FROM pages)
        WHERE word NOT IN ({_STOP_SQL}) GROUP BY 1 ORDER BY n DESC, word LIMIT 20""",
)
def top_words(spark, d):
    """HTML pages to text, tokens, counts without stop words, the 20 most frequent."""
    pages = spread(table(spark, d, "pages").select("html"))
    freq = wd.word_freq(pages, tx.strip_html("html"), STOP)
    return wd.top_words(freq, 20)


@query(
    "top_words_first_seen",
    rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '([\p{{L}}\p{{N}}]+)', 1)) AS word,
           unnest(range(len(regexp_extract_all(text, '([\p{{L}}\p{{N}}]+)', 1))))::INTEGER AS pos FROM documents)
        SELECT word, count(*)::BIGINT AS n, (min((doc_id, pos))).doc_id AS first_doc, (min((doc_id, pos))).pos AS first_pos
        FROM t WHERE word NOT IN ({_STOP_SQL}) GROUP BY 1 ORDER BY n DESC, first_doc, first_pos LIMIT 20""".replace(
        "(min((doc_id, pos))).doc_id", "min(doc_id * 4294967296 + pos) // 4294967296"
    ).replace("(min((doc_id, pos))).pos", "(min(doc_id * 4294967296 + pos) % 4294967296)::INTEGER"),
)
def top_words_first_seen(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return wd.top_words(wd.word_freq(docs, "text", STOP, doc_order="doc_id"), 20)


@query(
    "word_freq_by_lang",
    r"""SELECT lang, word, count(*)::BIGINT AS n FROM (
          SELECT lang, unnest(regexp_extract_all(text, '([\p{L}\p{N}]+)', 1)) AS word FROM documents)
        WHERE word NOT IN (SELECT DISTINCT unnest(regexp_extract_all(text, '([\p{L}\p{N}]+)', 1)) FROM benchmark)
        GROUP BY 1, 2""",
)
def word_freq_by_lang(spark, d):
    """Stop words from a table: the anti join meets distinct words only."""
    stop = table(spark, d, "benchmark").select(F.explode(tx.tokens("text")).alias("word")).distinct()
    docs = spread(table(spark, d, "documents").select("lang", "text"))
    return wd.word_freq(docs, "text", stop, by=["lang"])


@query(
    "word_freq_custom",
    r"""SELECT word, count(*)::BIGINT AS n, CASE word WHEN 'et al' THEN 'latin' WHEN 'of the' THEN 'glue' END
          AS word_group FROM (
          SELECT unnest(regexp_extract_all(text, '(\bof the\b|\bet al\b|[A-Za-z0-9]+)', 1)) AS word
          FROM (SELECT regexp_replace(text, '[^A-Za-z0-9 ]', '.', 'g') AS text FROM conversations)) GROUP BY 1""",
)
def word_freq_custom(spark, d):
    """Custom words of several tokens, with their groups."""
    plain = F.regexp_replace("text", "[^A-Za-z0-9 ]", ".")
    turns = table(spark, d, "conversations").select(plain.alias("text"))
    custom = {"of the": "glue", "et al": "latin"}
    return wd.word_freq(turns, "text", custom=custom, with_group=True)


@query(
    "word_freq_segmenter",
    r"""SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(lower(c_mktsegment || ' ' || c_name), ' '))
          AS word FROM customer) WHERE word <> '' GROUP BY 1""",
)
def word_freq_segmenter(spark, d):
    """Words from a user's own segmenter."""
    names = table(spark, d, "customer").select(F.concat_ws(" ", "c_mktsegment", "c_name").alias("text"))
    return wd.word_freq(names, "text", tokenizer=wd.with_segmenter(lambda t: t.lower().split(" ")))


@query(
    "counts_by",
    """SELECT event_type, ts::DATE AS day, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL""",
)
def counts_by(spark, d):
    return ag.counts_by(table(spark, d, "events"), ["event_type", F.to_date("ts").alias("day"), "user_id"])


@query(
    "dedupe",
    """SELECT l_suppkey, l_partkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (
         PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC,
         l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe(spark, d):
    lines = table(spark, d, "lineitem")
    order = [F.desc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")]
    return ag.dedupe(lines, ["l_suppkey", "l_partkey"], order).select(
        "l_suppkey", "l_partkey", "l_orderkey", "l_quantity"
    )


@query(
    "first_last_seen",
    """SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen,
         arg_max(props, (ts, event_id)) AS props, arg_max(value, (ts, event_id)) AS value
       FROM events GROUP BY 1, 2""",
)
def first_last_seen(spark, d):
    return ag.first_last_seen(
        table(spark, d, "events"), ["user_id", "event_type"], "ts", ["props", "value"], ["event_id"]
    )


@query(
    "latest_unexpired",
    """SELECT user_id, arg_max(props, (ts, event_id)) AS props, max(ts) AS ts FROM events
       WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1
       HAVING arg_max(ts + to_hours(CASE WHEN event_type = 'error' THEN 1 ELSE 6 END::INTEGER), (ts, event_id))
         >= TIMESTAMP '2024-01-20 12:00:00'""",
)
def latest_unexpired(spark, d):
    hours = F.when(F.col("event_type") == "error", 1).otherwise(6)
    return ag.latest_unexpired(
        table(spark, d, "events"), ["user_id"], "props", "ts",
        F.make_dt_interval(hours=hours),
        F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), ["event_id"],
    )


@query(
    "keys_like",
    """SELECT DISTINCT source FROM documents WHERE contains(source, 'rc1')""",
)
def keys_like(spark, d):
    return ag.keys_like(table(spark, d, "documents"), "source", "*rc1*")


@query(
    "pivot_interactions",
    """SELECT user_id,
         coalesce(arg_max(event_id, (ts, event_id)) FILTER (event_type = 'view'), 0) AS view,
         coalesce(arg_max(event_id, (ts, event_id)) FILTER (event_type = 'click'), 0) AS click,
         0::BIGINT AS absent FROM events GROUP BY 1""",
)
def pivot_interactions(spark, d):
    order = [F.col("ts"), F.col("event_id")]
    return ag.pivot_types(
        table(spark, d, "events"), ["user_id"], "event_type", "event_id", ["view", "click", "absent"], order
    )


@query(
    "pivot_array",
    """SELECT o_orderkey, o_custkey::VARCHAR AS follows, o_orderstatus AS fans, NULL::VARCHAR AS interaction
       FROM orders""",
)
def pivot_array(spark, d):
    from catalog.base import record

    pairs = F.array(
        record(type=F.lit("follows"), count=F.lit("old")),
        record(type=F.lit("fans"), count=F.col("o_orderstatus")),
        record(type=F.lit("follows"), count=F.col("o_custkey").cast("string")),
    )
    return table(spark, d, "orders").select(
        "o_orderkey", *[nested.typed_value(pairs, t).alias(t) for t in ("follows", "fans", "interaction")]
    )


@query(
    "next_run_ordinal",
    """SELECT 'loose' AS how, max(o_custkey)::BIGINT + 1 AS ordinal FROM orders
       UNION ALL SELECT 'strict', 1""",
)
def next_run_ordinal(spark, d):
    lead = F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise(F.lit(""))
    orders = table(spark, d, "orders")
    names = orders.select(F.concat(F.col("o_custkey").cast("string"), F.lit("_search_contents.csv")).alias("name"))
    odd = orders.select(F.concat(lead, F.col("o_custkey").cast("string"), F.lit("_x.csv")).alias("name"))
    loose = ag.next_run_ordinal(names).select(F.lit("loose").alias("how"), "ordinal")
    return loose.unionByName(ag.next_run_ordinal(odd, strict=True).select(F.lit("strict").alias("how"), "ordinal"))
