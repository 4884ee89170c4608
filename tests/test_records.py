"""Typed fields of drifting records, their problems, and one pass for both outputs."""

from feedloom.operators import records as rec
from feedloom.schemas import struct
from pyspark.sql import functions as F

FIELDS = {
    "id": rec.Field("bigint", ["$.id", "$.old.id"], required=True),
    "name": rec.Field("string", "$.user.name", required=True),
    "n": rec.Field("int", "$.n", default=7),
    "when": rec.Field("timestamp", "$.when"),
}


def test_fields_and_problems(spark):
    texts = {
        '{"id": 1, "user": {"name": "a"}, "n": 3, "more": [1]}': (1, "a", 3, []),
        '{"id": "12", "user": {"name": 5}}': (12, "5", 7, []),
        '{"id": null, "old": {"id": 9007199254740993}, "user": {"name": "b"}, "n": null}': (9007199254740993, "b", 7, []),
        '{"id": 1.5, "user": {"name": ""}, "n": "x"}': (1, "", 7, ["missing:name", "type:n"]),
        '{"id": "x", "user": "no"}': (None, None, 7, ["type:id", "missing:name"]),
        "[1, 2]": (None, None, 7, ["missing:id", "missing:name"]),
        "{broken": (None, None, 7, ["not json"]),
        "": (None, None, 7, ["empty"]),
        "null": (None, None, 7, ["missing:id", "missing:name"]),
    }
    df = spark.createDataFrame([(t, 1, "clash") for t in [*texts, None]], "payload string, own int, n string")
    rows = {r.payload: r for r in rec.check_records(df, FIELDS).collect()}
    for text, (i, name, n, problems) in texts.items():
        r = rows[text]
        assert (r.id, r["name"], r.n, r.problems, r.own) == (i, name, n, problems, 1), text
    assert rows[None].problems == ["empty"]


def test_one_pass_keeps_every_row(spark, tmp_path):
    rows = [(i, f'{{"id": {i}, "user": {{"name": "u"}}}}' if i % 3 else f'{{"id": {i}}}') for i in range(60)]
    checked = rec.check_records(spark.createDataFrame(rows, "key int, payload string"), FIELDS)
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parse_json(") <= 2
    path = str(tmp_path / "t")
    rec.land_checked(checked, path)
    none = str(tmp_path / "none")
    rec.land_checked(checked.where("key < 0"), none)
    assert rec.read_valid(spark, none, checked.schema).count() == 0
    valid, bad = rec.read_valid(spark, path), rec.read_quarantine(spark, path, ["key", "payload"])
    assert sorted(r.key for r in valid.collect()) == [i for i in range(60) if i % 3]
    assert sorted(tuple(r) for r in bad.collect()) == [(i, t, ["missing:name"]) for i, t in rows if not i % 3]
    assert "PartitionFilters: [isnotnull(record_state" in valid._jdf.queryExecution().executedPlan().toString()


def test_columns(spark):
    df = spark.createDataFrame([("1", "t", "3"), ("", " ", "x"), (None, "t", None)], "note_id string, title string, n string")
    got = rec.check_columns(df, ["note_id", "title"], struct("n INT")).select(F.col(rec.PROBLEMS)).collect()
    assert [r[0] for r in got] == [[], ["missing:note_id", "missing:title", "type:n"], ["missing:note_id"]]
