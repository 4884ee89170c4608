"""Upsert properties, writers, layout, tables."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.schemas import CANONICAL
from feedloom.sinks import files, upsert as up

SCHEMA = "k string, v string, n int, last_modify_ts bigint, seq int"
KEYS, ORDER = ["k"], ["last_modify_ts", "seq"]


def rows(df):
    return sorted((r.k, r.v, r.n, r.last_modify_ts, r.add_ts) for r in df.collect())


def replay(updates):
    """The same upserts one by one."""
    state = {}
    for k, v, n, ts, seq in sorted(updates, key=lambda u: (u[3], u[4])):
        added = state[k][4] if k in state else ts
        state[k] = (k, v, n, ts, added)
    return sorted(state.values())


@pytest.fixture
def updates():
    rng = random.Random(3)
    return [(f"k{0 if i % 3 == 0 else rng.randrange(20)}", rng.choice(["a", "b", None]), i, rng.randrange(50), i) for i in range(600)]


def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", add_ts bigint")


def test_upsert_equals_replay(spark, updates):
    df = spark.createDataFrame(updates, SCHEMA)
    assert rows(up.upsert(empty(spark), df, KEYS, ORDER)) == replay(updates)


def test_upsert_in_two_steps(spark, updates):
    updates.sort(key=lambda u: (u[3], u[4]))
    first, second = (spark.createDataFrame(u, SCHEMA) for u in (updates[:250], updates[250:]))
    once = up.upsert(empty(spark), first, KEYS, ORDER)
    twice = up.upsert(once, second, KEYS, ORDER)
    assert rows(twice) == replay(updates)
    assert rows(up.upsert(twice, second, KEYS, ORDER)) == rows(twice)  # idempotent


def test_null_overwrites_and_target_columns_stay(spark):
    target = spark.createDataFrame([("a", "old", 1, "keep")], "k string, v string, add_ts bigint, own string")
    new = spark.createDataFrame([("a", None, 9, "x"), ("b", "v", 9, "y")], "k string, v string, last_modify_ts bigint, fresh string")
    got = {r.k: r for r in up.upsert(target, new, ["k"], ["last_modify_ts"]).collect()}
    assert (got["a"].v, got["a"].add_ts, got["a"].own, got["a"].fresh) == (None, 1, "keep", "x")
    assert (got["b"].add_ts, got["b"].own) == (9, None)


def test_versions(spark, updates, tmp_path):
    path = str(tmp_path / "t")
    assert up.current(spark, path) is None
    updates.sort(key=lambda u: (u[3], u[4]))
    for part in (updates[:300], updates[300:]):
        files.sink(spark.createDataFrame(part, SCHEMA), "sqlite", path=path, keys=KEYS, order=ORDER)
    assert up.versions(spark, path) == [0, 1]
    assert rows(up.current(spark, path)) == replay(updates)
    # A version without _SUCCESS does not count; writing a version again replaces it.
    (tmp_path / "t" / "v=0000000002").mkdir()
    assert up.versions(spark, path) == [0, 1]
    up.upsert_path(spark.createDataFrame(updates[300:], SCHEMA), path, KEYS, ORDER, version=1)
    assert rows(up.current(spark, path)) == replay(updates)


def test_update_where(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    assert sorted(map(str, (r.n for r in up.update_where(df, {"n": 0}, "k", "b").collect()))) == ["0", "1", "3"]
    assert up.affected(df, "k", None).first().affected == 1


def test_unknown_sink(spark):
    with pytest.raises(ValueError):
        files.sink(empty(spark), "excel", path="x")


def test_csv_flattens_and_appends(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.sql("""SELECT 'a"b,c\nd' AS t, array('x', NULL, 'y') AS l, map('k', '猫') AS m, named_struct('z', 1) AS s""")
    for _ in range(2):
        files.sink(df, "csv", path=path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert [tuple(r) for r in back.collect()] == [('a"b,c\nd', "x,,y", '{"k":"猫"}', '{"z":1}')] * 2


def test_json_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "json")
    files.sink(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), "json", path=path)
    assert spark.read.text(path).first().value == '{"a":1,"b":null}'


def test_layout(spark):
    assert files.output_path("data", "xhs", "search", "contents", "2024-01-02", "csv", 3) == "data/xhs/3_search_contents_2024-01-02.csv"
    assert files.output_path("data", "wb", "search", "comments", "2024-01-02", "json") == "data/wb/search_comments_2024-01-02.json"
    r = files.with_layout(spark.range(1), "xhs", "search", "contents", "2024-01-02").first()
    assert (r.platform, r.run_type, r.role, str(r.ingest_date)) == ("xhs", "search", "contents", "2024-01-02")


def test_init_tables_and_append(spark):
    made = files.init_tables(spark, "feed")
    assert set(made) == {f"feed.{role}" for role in CANONICAL}
    edge = spark.sql("SELECT '1' AS up_id, '2' AS fan_id, 'bili' AS platform, 5L AS add_ts, 5L AS last_modify_ts, "
                     "'' AS up_name, '' AS fan_name, '' AS up_sign, '' AS fan_sign, '' AS up_avatar, '' AS fan_avatar")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    files.append_table(edge, "feed.contact_edge")
    files.append_table(edge, "feed.contact_edge")
    assert spark.table("feed.contact_edge").where("platform = 'bili' AND fan_id = '2'").count() == 2
    files.init_tables(spark, "feed")
    assert spark.table("feed.contact_edge").count() == 0


def test_evolve(spark):
    old = spark.createDataFrame([(1, None)], "id int, a string")
    out = files.evolve(old, StructType.fromDDL("id INT, a STRING, b BIGINT"), {"a": "-", "b": 0})
    assert tuple(out.first()) == (1, "-", 0)
    both = files.append_evolved(old.drop("a"), spark.createDataFrame([(2, "x")], "id int, c string"), {"c": "none"})
    assert sorted(map(tuple, both.collect())) == [(1, "none"), (2, "x")]


def test_ties_are_settled_by_the_payload(spark):
    rows = [("a", "x", {"m": "1"}, 5), ("a", "z", {"m": "2"}, 5), ("a", "y", {"m": "3"}, 5)]
    df = spark.createDataFrame(rows, "k string, v string, m map<string,string>, last_modify_ts bigint")
    for frame in (df, df.orderBy(F.desc("v")), df.repartition(3)):
        assert up.last_updates(frame, ["k"], ["last_modify_ts"], "last_modify_ts").first().v == "z"
        assert up.last_updates(frame.drop("m"), ["k"], ["last_modify_ts"], "last_modify_ts").first().v == "z"


def test_last_updates_is_partial_before_the_shuffle(spark, updates):
    df = spark.createDataFrame(updates, SCHEMA)
    plan = up.last_updates(df, KEYS, ORDER, "last_modify_ts")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(" in plan and plan.rfind("partial_max(") > plan.rfind("Exchange")


def test_versions_ignore_other_folders(spark, tmp_path):
    (tmp_path / "x").mkdir()
    assert up.versions(spark, str(tmp_path)) == []
    assert up.keep_all_keywords(spark.range(1).withColumn("source_keyword", F.lit("a")), ["id"]) == ["id", "source_keyword"]


def test_small_and_large_updates_merge_alike(spark, updates, monkeypatch):
    updates.sort(key=lambda u: (u[3], u[4]))
    first, second = (spark.createDataFrame(u, SCHEMA).cache() for u in (updates[:250], updates[250:]))
    once = up.upsert(empty(spark), first, KEYS, ORDER).withColumn("own", F.col("k"))
    results = []
    for small in (True, False):
        monkeypatch.setattr(up, "is_small", lambda df: small)
        merged = up.upsert(once, second.withColumn("fresh", F.lit(1)), KEYS, ORDER)
        results.append((merged.columns, sorted(map(tuple, merged.collect()), key=repr)))
    assert results[0] == results[1]


def test_small_updates_do_not_shuffle_the_target(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    target = events.select(F.col("event_id").alias("k"), "props", F.lit(1).cast("bigint").alias("add_ts"))
    new = spark.range(5, 9).select(F.col("id").alias("k"), F.lit("x").alias("props"), F.col("id").alias("last_modify_ts"))
    plan = up.upsert(target, new, ["k"], ["last_modify_ts"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "FullOuter" not in plan


def test_platform_tables(spark, tmp_path):
    from feedloom.normalize import tables, xhs
    from feedloom.schemas import NATURAL_KEYS

    assert set(tables.FILLERS) == set(NATURAL_KEYS)
    made = tables.init_platform_tables(spark, "platforms")
    assert len(made) == 22
    for name, keys in NATURAL_KEYS.items():
        assert set(keys) <= set(spark.table(f"platforms.{name}").columns)
    notes = xhs.normalize_note(spark.createDataFrame([('{"note_id":"1","title":"a"}',)], "payload string"), 5)
    tables.insert_rows(notes, "platforms", "xhs_note")
    assert spark.table("platforms.xhs_note").first().add_ts == 5
    again = xhs.normalize_note(spark.createDataFrame([('{"note_id":"1","title":"b"}',)], "payload string"), 9)
    for rows in (notes, again):
        tables.upsert_rows(rows, str(tmp_path), "xhs_note")
    row = up.current(spark, f"{tmp_path}/xhs_note").first()
    assert (row.title, row.add_ts, row.last_modify_ts) == ("b", 5, 9)


def test_bucketed_tables_join_without_a_shuffle(spark):
    from feedloom.operators.joins import comments_of

    content = spark.range(100).select(F.col("id").alias("content_id"), F.lit("x").alias("kind"))
    comment = spark.range(1000).select((F.col("id") % 100).alias("content_id"), F.col("id").alias("comment_id"))
    files.write_bucketed(content, "bucketed_content", ["content_id"], 4)
    files.write_bucketed(comment, "bucketed_comment", ["content_id"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = comments_of(spark.table("bucketed_content"), spark.table("bucketed_comment"), ["content_id"], ["kind"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_forms_agree(spark, tmp_path):
    """Late updates, equal order, NULL keys, columns that come and go, in any number of batches."""
    rng = random.Random(11)
    for trial in range(3):
        table, parts = None, []
        for batch in range(3):
            data = [
                (rng.choice(["a", "b", "c", None]), rng.choice([1, None]), rng.choice(["x", None]), rng.randrange(20), i)
                for i in range(rng.randrange(0, 9))
            ]
            df = spark.createDataFrame(data, "k string, j int, v string, last_modify_ts bigint, seq int")
            if (batch + trial) % 3 == 1:
                df = df.withColumn("w", F.concat(F.lit(f"{batch}-"), F.col("seq").cast("string"))).drop("v")
            parts.append(df)
        keys, order, path = ["k", "j"], ["last_modify_ts", "seq"], str(tmp_path / f"t{trial}")
        for batch, df in enumerate([*parts, parts[-1]]):
            up.append_updates(df, path, keys, order, min(batch, 2))
            if table is None:
                table = up.last_updates(df, keys, order, "last_modify_ts").withColumnRenamed("_first_seen", "add_ts")
            else:
                merged = up.upsert(table, df, keys, order)
                new = up.last_updates(df, keys, order, "last_modify_ts")
                full = up._merge_full(table, new, keys)
                show = lambda d: sorted(map(str, (r.asDict().items() for r in d.select(sorted(d.columns)).collect())))
                assert show(merged) == show(full)
                table = merged
        read = up.read_upserts(spark, path, keys, order)
        assert show(read) == show(table)
        up.compact_upserts(spark, path, path + "-c", keys, order)
        assert show(up.read_upserts(spark, path + "-c", keys, order)) == show(table)


def test_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", "v", 1, 1, 1)], SCHEMA)
    up.upsert_path(one, path, KEYS, ORDER)
    monkeypatch.setattr(up, "versions", lambda *a: [])  # as seen before the other writer was done
    with pytest.raises(Exception, match="(?i)exist"):
        up.upsert_path(one, path, KEYS, ORDER)


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        up.upsert_path(spark.createDataFrame([(f"k{i}", "v", 1, i, 1)], SCHEMA), path, KEYS, ORDER)
    up.drop_versions(spark, path, keep=2)
    assert up.versions(spark, path) == [2, 3] and up.current(spark, path).count() == 4


def test_a_new_checkpoint_is_a_run_of_its_own(spark, tmp_path):
    path = str(tmp_path / "t")
    first = up.run_of(spark, path, "/cp/1")
    one = spark.createDataFrame([("a", "v", 1, 5, 1)], SCHEMA)
    up.append_updates(one, path, KEYS, ORDER, 0, run=first)
    assert up.run_of(spark, path, "/cp/1") == first
    second = up.run_of(spark, path, "/cp/2")
    up.append_updates(spark.createDataFrame([("b", "w", 1, 1, 1), ("a", "late", 1, 1, 1)], SCHEMA), path, KEYS, ORDER, 0, run=second)
    assert rows(up.read_upserts(spark, path, KEYS)) == [("a", "late", 1, 1, 5), ("b", "w", 1, 1, 1)]
