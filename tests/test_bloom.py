"""Filters of keys lose nothing, let little else pass, and stand below the exchange."""

import pytest
from feedloom.operators import bloom, joins
from pyspark.sql import functions as F


@pytest.mark.parametrize("keys", [["id"], ["id", "name"]])
def test_nothing_is_lost(spark, keys):
    df = spark.range(4000).select((F.col("id") * 7919).alias("id"), F.col("id").cast("string").alias("name"))
    few = df.where("id % 8 = 0").unionByName(spark.createDataFrame([(None, "x")], "id long, name string"))
    wanted = {tuple(r) for r in few.select(*keys).na.drop().collect()}
    found = bloom.semi_filtered(df.unionByName(few), few, keys, few.count())
    got = [tuple(r) for r in found.select(*keys).collect()]
    assert wanted <= set(got) and None not in {g[0] for g in got}
    assert len(set(got) - wanted) < 0.15 * 3500


def test_sizes(spark):
    few = spark.range(10)
    assert bloom.Bloom(few, ["id"], 1).bits == bloom.FEWEST_BITS
    assert bloom.Bloom(few, ["id"], 10**9).bits == bloom.MOST_BITS
    assert 0 < bloom.Bloom(few, ["id"], 10).share() <= 20 / (1 << bloom.FEWEST_BITS)
    assert bloom.Bloom(few.where("id < 0"), ["id"], 0).share() == 0
    assert bloom.semi_filtered(few, few, ["id"], 10**9) is few


def rows_of_exchanges(df):
    """Rows that each exchange of a run wrote."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            walk(node.plan())
        if name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return found


def test_few_contents_are_exchanged(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        content = spark.range(60_000).select(F.col("id"), (F.col("id") % 5000).alias("author"), F.lit("x" * 20).alias("body"))
        seeds = spark.range(50).select((F.col("id") * 300).alias("author"))
        lost = joins.missing(seeds, content, "author")
        # 17 of 5000 authors are seeds: their keys and few others
        assert max(rows_of_exchanges(lost)) < 2000
        assert sorted(r.author for r in lost.collect()) == [300 * i for i in range(17, 50)]
        mine = joins.contents_of(seeds, content, "author", "author", [F.col("id")], 3)
        assert max(rows_of_exchanges(mine)) < 2000
        assert mine.count() == 17 * 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_both_sides_of_the_limit_agree(spark):
    content = spark.createDataFrame([(i, i % 7 if i % 5 else None) for i in range(100)], "id int, author int")
    seeds = spark.createDataFrame([(0,), (3,), (9,), (9,), (None,)], "author int")
    newest = [F.desc("id")]
    results = []
    for limit in (10 << 20, -1):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            lost = sorted(map(str, joins.missing(seeds, content, "author").collect()))
            mine = joins.contents_of(seeds.distinct(), content, "author", "author", newest, 2)
            results.append((lost, sorted(map(str, mine.collect()))))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert results[0] == results[1]
    assert len(results[0][0]) == 3
