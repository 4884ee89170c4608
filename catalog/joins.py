"""Join queries."""

from pyspark.sql import functions as F

from catalog.base import query, record, table, text
from feedloom.operators import joins as jn
from feedloom.operators.sets import contact_edges, flatten_comments, union_platforms, union_sources


@query(
    "details",
    """SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def details(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return jn.details(docs, table(spark, d, "labels"), "doc_id")


@query(
    "missing_seeds",
    """SELECT doc_id FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 1000000000 FROM labels)
       WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def missing_seeds(spark, d):
    labels = table(spark, d, "labels").select("doc_id")
    seeds = labels.unionByName(labels.select((F.col("doc_id") + 1000000000).alias("doc_id")))
    return jn.missing(seeds, table(spark, d, "documents"), "doc_id")


@query(
    "contents_of_creator",
    """SELECT c_name, o_custkey, o_orderkey, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
       JOIN customer ON c_custkey = o_custkey WHERE rn <= 5""",
)
def contents_of_creator(spark, d):
    creators = table(spark, d, "customer").select("c_custkey", "c_name")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    newest = [F.desc("o_orderdate"), F.col("o_orderkey")]
    out = jn.contents_of(creators, orders, "c_custkey", "o_custkey", newest, 5)
    return out.select("c_name", "o_custkey", "o_orderkey", "o_totalprice")


@query(
    "contents_of_kind",
    """SELECT c_custkey, o_orderkey, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey
       WHERE o_orderstatus IN ('F', 'P')""",
)
def contents_of_kind(spark, d):
    creators = table(spark, d, "customer").select("c_custkey")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    out = jn.contents_of(creators, orders, "c_custkey", "o_custkey", kinds=["F", "P"], kind_col="o_orderstatus")
    return out.select("c_custkey", "o_orderkey", "o_orderstatus")


@query(
    "comments_of_content",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderpriority
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def comments_of_content(spark, d):
    content = table(spark, d, "orders").withColumn("l_orderkey", F.col("o_orderkey"))
    comment = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return jn.comments_of(content, comment, ["l_orderkey"], ["o_custkey", "o_orderpriority"])


def _thread(spark, d):
    """Conversation turns as comments, each answering the turn before it."""
    return table(spark, d, "conversations").select(
        F.lit("wb").alias("platform"),
        F.col("conv_id").alias("content_id"),
        F.col("turn").alias("comment_id"),
        F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_comment_id"),
        "role",
        "text",
    )


@query(
    "comments_with_parent",
    """SELECT a.conv_id AS content_id, a.turn AS comment_id, a.role, b.role AS parent_role, b.text AS parent_text
       FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""",
)
def comments_with_parent(spark, d):
    out = jn.attach_parent(_thread(spark, d), ["role", "text"])
    return out.select("content_id", "comment_id", "role", "parent_role", "parent_text")


@query(
    "comments_with_parent_salted",
    """SELECT a.conv_id AS content_id, a.turn AS comment_id, b.role AS parent_role
       FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""",
)
def comments_with_parent_salted(spark, d):
    """The same join with hot keys split, as it runs on large inputs."""
    from feedloom.operators.skew import balanced_join

    comment = _thread(spark, d).select("content_id", "comment_id", "parent_comment_id")
    parents = _thread(spark, d).select(
        "content_id", F.col("comment_id").alias("parent_comment_id"), F.col("role").alias("parent_role")
    )
    out = balanced_join(
        comment, parents, ["content_id", "parent_comment_id"], "left", always=True, share=0.001,
        scatter_by=["content_id", "comment_id"],
    )
    return out.select("content_id", "comment_id", "parent_role")


@query(
    "comments_of_hot_content",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority FROM lineitem
       JOIN orders ON o_orderkey = CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_orderkey END""",
)
def comments_of_hot_content(spark, d):
    """A third of all comments under one content."""
    from feedloom.operators.skew import balanced_join

    key = F.when(F.col("l_partkey") % 3 == 0, F.lit(7)).otherwise(F.col("l_orderkey"))
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, d, "lineitem").select(*ids, key.alias("o_orderkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    out = balanced_join(lines, orders, ["o_orderkey"], always=True, scatter_by=ids)
    return out.drop("o_orderkey")


@query(
    "resolve_author",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN o_orderpriority WHEN 'F' THEN 'fixed' END AS author
       FROM orders""",
)
def resolve_author(spark, d):
    users = F.create_map(F.lit("P"), F.col("o_orderpriority"), F.lit("F"), F.lit("fixed"))
    orders = table(spark, d, "orders")
    return jn.resolve_author(orders, users, "o_orderstatus").select("o_orderkey", "author")


@query(
    "decode_labels",
    """SELECT c_custkey, n_name, r_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm'
         ELSE 'other' END AS segment
       FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def decode_labels(spark, d):
    nations = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    out = jn.decode_from(table(spark, d, "customer"), nations, ["c_nationkey"])
    out = jn.decode_from(out, regions, ["n_regionkey"])
    out = jn.decode(out, "c_mktsegment", {"BUILDING": "b", "MACHINERY": "m"}, "segment", "other")
    return out.select("c_custkey", "n_name", "r_name", "segment")


@query(
    "zip_pairs",
    """SELECT c_custkey, 'a' AS id, c_name AS token FROM customer
       UNION ALL SELECT c_custkey, c_mktsegment, 't' FROM customer
       UNION ALL SELECT c_custkey, 'z', NULL FROM customer""",
)
def zip_pairs(spark, d):
    lists = table(spark, d, "customer").select(
        "c_custkey",
        F.array(F.lit("a"), F.col("c_mktsegment"), F.lit("z")).alias("id"),
        F.array(F.col("c_name"), F.lit("t")).alias("token"),
    )
    return jn.explode_pairs(lists, "id", "token")


@query(
    "prefer_detail",
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(CASE WHEN a.lang <> 'de' THEN a.lang END, b.note)
         AS lang, a.n_chars FROM (SELECT * FROM documents WHERE lang <> 'fr') a
       FULL JOIN (SELECT doc_id, 'label' || quality AS note FROM labels) b ON a.doc_id = b.doc_id""",
)
def prefer_detail(spark, d):
    docs = table(spark, d, "documents").where("lang <> 'fr'")
    primary = docs.select("doc_id", F.nullif("lang", F.lit("de")).alias("lang"), "n_chars")
    fallback = table(spark, d, "labels").select("doc_id", text("label", F.col("quality")).alias("lang"))
    return jn.prefer(primary, fallback, ["doc_id"])


@query(
    "contact_edges",
    """SELECT DISTINCT l_suppkey AS up_id, l_partkey AS fan_id FROM lineitem
       UNION SELECT DISTINCT l_partkey, l_suppkey FROM lineitem""",
)
def edges(spark, d):
    lines = table(spark, d, "lineitem")
    fans = lines.select(F.col("l_suppkey").alias("up_id"), F.col("l_partkey").alias("fan_id"))
    followings = lines.select(F.col("l_partkey").alias("up_id"), F.col("l_suppkey").alias("fan_id"))
    return contact_edges(fans, followings)


@query(
    "flatten_comments",
    r"""SELECT conv_id, 1 AS level, turn::VARCHAR AS id, role FROM conversations
        UNION ALL SELECT conv_id, 2, turn || '-a', NULL FROM conversations WHERE role <> 'system'
        UNION ALL SELECT conv_id, 2, turn || '-b', NULL FROM conversations WHERE role <> 'system'""",
)
def flatten(spark, d):
    replies = F.array(*[record(id=text(F.col("turn"), f"-{x}")) for x in "ab"])
    tree = table(spark, d, "conversations").select(
        "conv_id",
        F.col("turn").cast("string").alias("id"),
        "role",
        F.when(F.col("role") != "system", replies).alias("sub_comments"),
    )
    return flatten_comments(tree, "sub_comments", shared=["conv_id"])


@query(
    "union_sources",
    """SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents
       UNION ALL SELECT page_id, NULL, url FROM pages""",
)
def union_two(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return union_sources(docs, table(spark, d, "pages").select(F.col("page_id").alias("id"), "url"))


@query(
    "union_platforms",
    """SELECT 'xhs' AS platform, doc_id::VARCHAR AS content_id, lang, NULL::INTEGER AS size FROM documents
       UNION ALL SELECT 'dy', p_partkey::VARCHAR, NULL, p_size FROM part
       UNION ALL SELECT 'wb', o_orderkey::VARCHAR, NULL, NULL FROM orders""",
)
def platforms(spark, d):
    def content(name, platform, key, *rest):
        return table(spark, d, name).select(
            F.lit(platform).alias("platform"), F.col(key).cast("string").alias("content_id"), *rest
        )

    return union_platforms(
        content("documents", "xhs", "doc_id", "lang"),
        content("part", "dy", "p_partkey", F.col("p_size").alias("size")),
        content("orders", "wb", "o_orderkey"),
    )
