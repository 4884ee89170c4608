"""Streams over several micro-batches against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators.ranking import latest
from feedloom.sinks import upsert
from feedloom.sinks.upsert import last_updates
from feedloom.streaming import ingest, state

SCHEMA = "id int, k string, t string, ts timestamp"


@pytest.fixture
def landed(spark, tmp_path):
    """300 rows in four files, a third of them under one key."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(9)}", rng.choice(["a b", "b c a", "的 x"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, t string").withColumn("ts", F.timestamp_seconds(F.col("id") * 600 + 1704067200))
    path = str(tmp_path / "in")
    for part in range(4):
        df.where(f"id >= {part * 75} AND id < {part * 75 + 75}").coalesce(1).write.mode("append").parquet(path)
    return path, df


def run(spark, stream, mode, root):
    out = str(root / "out")

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with ingest.no_empty_batches(spark):
        q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", str(root / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def source(spark, path):
    return ingest.read_stream(spark, path, SCHEMA, files_per_trigger=1)


def test_ingest_sees_every_row_once(spark, landed, tmp_path):
    path, df = landed
    sizes = []
    ingest.stream_ingest(source(spark, path), lambda b, i: sizes.append(b.count()), str(tmp_path / "cp")).awaitTermination()
    assert sizes == [75] * 4


def test_upsert_stream_equals_batch(spark, landed, tmp_path):
    path, df = landed
    rows = lambda d: d.select("k", "t", "id", F.unix_millis("ts").alias("last_modify_ts"))
    out = str(tmp_path / "t")
    ingest.stream_upsert(rows(source(spark, path)), out, ["k"], ["last_modify_ts"], str(tmp_path / "cp")).awaitTermination()
    want = sorted(map(tuple, last_updates(rows(df), ["k"], ["last_modify_ts"], "last_modify_ts").collect()))
    got = upsert.read_upserts(spark, out, ["k"], ["last_modify_ts"])
    assert sorted(map(tuple, got.collect())) == want
    upsert.compact_upserts(spark, out, str(tmp_path / "c"), ["k"], ["last_modify_ts"])
    assert sorted(map(tuple, upsert.read_upserts(spark, str(tmp_path / "c"), ["k"], ["last_modify_ts"]).collect())) == want


def test_first_n_over_the_life_of_the_stream(spark, landed, tmp_path):
    path, df = landed
    got = run(spark, state.stream_first_n(source(spark, path), ["k"], ["id"], 7), "append", tmp_path)
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        want.setdefault(r.k, []).append(r.id)
    assert {r.id for r in got.collect()} == {i for ids in want.values() for i in ids[:7]}


@pytest.mark.parametrize("salts", [1, 4])
def test_dedupe(spark, landed, tmp_path, salts):
    path, df = landed
    got = run(spark, ingest.stream_dedupe(source(spark, path), ["k"], "ts", "30 days", salts), "append", tmp_path)
    assert sorted(r.k for r in got.collect()) == sorted({r.k for r in df.collect()})


def test_word_counts(spark, landed, tmp_path):
    path, df = landed
    out = run(spark, ingest.stream_word_freq(source(spark, path), "t", ["b"]), "update", tmp_path)
    got = {r.word: r.n for r in latest(out, ["word"], [F.desc("batch_id")]).collect()}
    texts = [r.t for r in df.collect()]
    assert got == {w: sum(w in t.split() for t in texts) for w in ("a", "c", "的", "x")}


def test_daily_counts(spark, landed, tmp_path):
    path, df = landed
    out = run(spark, ingest.stream_daily_counts(source(spark, path), "ts", ["k"]), "update", tmp_path)
    got = {(str(r.day), r.k): r.n for r in latest(out, ["day", "k"], [F.desc("batch_id")]).collect()}
    want = {(str(r.d), r.k): r["count"] for r in df.groupBy(F.to_date("ts").alias("d"), "k").count().collect()}
    assert got == want


def test_expiring_state_remembers_until_the_ttl(spark, landed, tmp_path):
    path, df = landed
    held = state.expiring_state(source(spark, path).select("k", "t", "id"), ["k"], "t", ["id"], 3600)
    out = run(spark, held, "update", tmp_path)
    by_key = {}
    for r in sorted(out.collect(), key=lambda r: r.id):
        assert r.previous == by_key.get(r.k)
        by_key[r.k] = r.t
    last = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        last[r.k] = r.t
    assert by_key == last


def test_expired_values_are_gone(spark, landed, tmp_path):
    path, _ = landed
    held = state.expiring_state(source(spark, path).select("k", "t", "id"), ["k"], "t", ["id"], 0.001)
    out = run(spark, held, "update", tmp_path)
    assert out.where("previous IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        state.expiring_state(source(spark, path), ["k"], "t", ["id"], 0)


def test_ids_keep_every_bit(spark, tmp_path):
    big = 9007199254740993
    rows = [(big, "a"), (None, "a"), (big + 2, "b"), (big + 4, "b"), (None, "b")]
    path = str(tmp_path / "in")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "id long, k string").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: ingest.read_stream(spark, path, "id long, k string", files_per_trigger=1)
    got = run(spark, state.stream_first_n(stream(), ["k"], ["id"], 2), "append", tmp_path / "n")
    assert {r.id for r in got.where("k = 'b'").collect()} == {big + 2, big + 4}
    assert {r.id for r in got.where("k = 'a'").collect()} == {big, None}
    held = state.expiring_state(stream(), ["k"], "id", ["id"], 3600)
    out = run(spark, held, "update", tmp_path / "e")
    assert {(r.k, r.id, r.previous) for r in out.collect()} == {("a", None, None), ("b", big + 2, None), ("b", None, big + 2)}


def swept(rows, ttl, delay=0):
    """What ``sweeping_state`` says, by the rows of each batch: (t, key, value)."""
    held, out, mark = {}, [], None
    for batch in rows:
        last = {}
        for t, k, v in sorted(batch):
            last[k] = (t, v)
        for k, (t, v) in last.items():
            before = None
            if k in held:
                t0, v0 = held[k]
                if (t, v) < (t0, v0):
                    continue
                if t0 + ttl <= t:
                    out.append((k, v0, None, "expired", t0 + ttl))
                else:
                    before = v0
            held[k] = (t, v)
            out.append((k, v, before, "set", t))
        for k, (t, v) in list(held.items()):
            if mark is not None and t + ttl < mark:
                out.append((k, v, None, "expired", t + ttl))
                del held[k]
        mark = max([mark or 0, *(t - delay for t, _, _ in batch)])
    return sorted(map(str, out)), held


@pytest.mark.parametrize("ttl, delay", [(300, 0), (40, 0), (2000, 30), (90, 100)])
def test_expired_values_are_told(spark, tmp_path, ttl, delay):
    rng = random.Random(ttl)
    batches = []
    for part in range(6):
        rows = [(rng.randrange(part * 100, part * 100 + 100), f"k{rng.randrange(6 if part % 2 else 12)}", rng.choice("abc")) for _ in range(25)]
        batches.append(rows + [(5, "k1", "late")])
        frame = spark.createDataFrame([(k, v, t) for t, k, v in batches[-1]], "k string, v string, t long")
        frame.withColumn("ts", F.timestamp_millis(F.col("t") * 1000)).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), "k string, v string, ts timestamp", files_per_trigger=1)
    out = run(spark, state.sweeping_state(stream, ["k"], "v", "ts", ttl, f"{delay} seconds", ["v"]), "update", tmp_path)
    got = sorted(str((r.k, r.v, r.previous, r.event, r["at"] // 1000)) for r in out.collect())
    want, held = swept(batches, ttl, delay)
    assert got == want
    keys = {r.key.k for r in state.held_keys(spark, str(tmp_path / "cp")).collect()}
    assert keys == set(held)
    assert {r.key.k for r in state.held_keys(spark, str(tmp_path / "cp"), "*k1*").collect()} == {k for k in held if "k1" in k}
    with pytest.raises(ValueError):
        state.sweeping_state(stream, ["k"], "v", "ts", 0)
