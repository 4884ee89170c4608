"""Bucketed copy-on-write upserts: equal to plain ones, and only touched buckets are written."""

import random

import pytest
from feedloom.sinks import buckets as bk, upsert as up
from feedloom.streaming import ingest
from pyspark.sql import functions as F

KEYS, ORDER = ["k", "j"], ["last_modify_ts", "seq"]
SCHEMA = "k string, j int, v string, last_modify_ts bigint, seq int"


def show(df):
    return sorted(map(str, (r.asDict().items() for r in df.select(sorted(df.columns)).collect())))


def random_batch(spark, rng, number):
    data = [
        (rng.choice(["a", "b", "c", "d", None]), rng.choice([1, 2, None]), rng.choice(["x", "y", None]), rng.randrange(20), i)
        for i in range(rng.randrange(0, 9))
    ]
    df = spark.createDataFrame(data, SCHEMA)
    if number % 3 == 1:
        df = df.withColumn("w", F.concat(F.lit(f"{number}-"), F.col("seq").cast("string"))).drop("v")
    return df


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_plain_upserts(spark, tmp_path, seed):
    """Writers in turn, named and not, with late rows, NULL keys, and columns that come and go."""
    rng, path, table = random.Random(seed), str(tmp_path / "t"), None
    batches = {"search": 0, "creator": 0}
    for number in range(6):
        df = random_batch(spark, rng, number)
        writer = rng.choice(["search", "creator", None])
        batch = batches.get(writer)
        done = bk.upsert_buckets(df, path, KEYS, ORDER, buckets=5, writer=writer, batch=batch)
        assert (done is None) == df.isEmpty()
        if writer:
            assert bk.upsert_buckets(df, path, KEYS, ORDER, writer=writer, batch=batch) is None or df.isEmpty()
            batches[writer] += 1
        if df.isEmpty():
            continue
        if table is None:
            table = up.last_updates(df, KEYS, ORDER, "last_modify_ts").withColumnRenamed("_first_seen", "add_ts")
        else:
            table = up.upsert(table, df, KEYS, ORDER)
        assert show(bk.read_buckets(spark, path)) == show(table)
    versions = bk.manifests(spark, path)
    assert versions == list(range(len(versions)))


def numbered(spark, first, last, value, ts):
    rows = spark.range(first, last).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.lit(1).alias("j"), F.lit(value).alias("v"),
        F.lit(ts).cast("bigint").alias("last_modify_ts"), F.lit(0).alias("seq"),
    )
    return rows


def test_untouched_buckets_are_not_written(spark, tmp_path):
    path = str(tmp_path / "t")
    assert bk.upsert_buckets(numbered(spark, 0, 10_000, "old", 1), path, KEYS, ORDER, buckets=64) == 0
    before = bk.manifest(spark, path)
    assert len(before.live) == 64
    assert bk.upsert_buckets(numbered(spark, 500, 510, "new", 2), path, KEYS, ORDER) == 1
    after = bk.manifest(spark, path)
    touched = {b for b in after.live if after.live[b] != before.live[b]}
    assert 0 < len(touched) <= 10
    written = [p.parent.name for p in (tmp_path / "t" / "data").glob("v=0000000001-*/*/part-*")]
    assert set(written) == {f"_bucket={b}" for b in touched}
    table = bk.read_buckets(spark, path)
    assert table.count() == 10_000 and table.where("v = 'new'").count() == 10
    assert bk.read_buckets(spark, path, version=0).where("v = 'new'").count() == 0
    inputs = bk.read_buckets(spark, path, only=sorted(touched)[:1]).inputFiles()
    assert len(inputs) == len(after.live[sorted(touched)[0]])


@pytest.mark.parametrize("own", [(20, 21), (0, 40)])
def test_overlapping_writers(spark, tmp_path, monkeypatch, own):
    """Another writer commits just before this one: nothing of either is lost, and data that
    shares no bucket is not merged again."""
    path = str(tmp_path / "t")
    bk.upsert_buckets(numbered(spark, 0, 40, "old", 1), path, KEYS, ORDER, buckets=32)
    create, merge, merges = bk.Folder.create, bk._merge, []

    def merged(*args):
        merges.append(1)
        return merge(*args)

    def late(self, name, text):
        monkeypatch.setattr(bk.Folder, "create", create)
        bk.upsert_buckets(numbered(spark, 0, 1, "other", 5), path, KEYS, ORDER)
        merges.clear()
        create(self, name, text)

    monkeypatch.setattr(bk, "_merge", merged)
    monkeypatch.setattr(bk.Folder, "create", late)
    assert bk.upsert_buckets(numbered(spark, *own, "mine", 3), path, KEYS, ORDER) == 2
    got = {r.k: r.v for r in bk.read_buckets(spark, path).collect()}
    want = {f"k{i}": "old" for i in range(40)} | {"k0": "other"} | {f"k{i}": "mine" for i in range(*own)}
    assert got == want
    assert len(merges) == (1 if own == (0, 40) else 0)


def test_a_commit_without_manifest_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert bk.read_buckets(spark, path) is None
    bk.upsert_buckets(numbered(spark, 0, 20, "old", 1), path, KEYS, ORDER, buckets=4)

    def broken(self, name, text):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(bk.Folder, "create", broken)
        with pytest.raises(OSError):
            bk.upsert_buckets(numbered(spark, 0, 20, "lost", 2), path, KEYS, ORDER)
    assert {r.v for r in bk.read_buckets(spark, path).collect()} == {"old"}
    for i in range(3):
        bk.upsert_buckets(numbered(spark, 0, 20, f"new{i}", 3 + i), path, KEYS, ORDER)
    assert bk.drop_dead_files(spark, path, keep=1) > 0
    assert bk.manifests(spark, path) == [3]
    assert {r.v for r in bk.read_buckets(spark, path).collect()} == {"new2"}
    left = {str(p.relative_to(path)) for p in (tmp_path / "t" / "data").glob("*/*/part-*")}
    assert left == {f for own in bk.manifest(spark, path).live.values() for f in own}


def test_other_keys_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    bk.upsert_buckets(numbered(spark, 0, 2, "v", 1), path, KEYS, ORDER)
    with pytest.raises(ValueError):
        bk.upsert_buckets(numbered(spark, 0, 2, "v", 1), path, ["k"], ORDER)


def test_stream_of_batches(spark, tmp_path):
    """Several micro-batches, a restart, and a second stream: as one upsert after the other."""
    out, table = str(tmp_path / "t"), None
    for name, first in (("one", 0), ("two", 15)):
        source = str(tmp_path / name)
        for part in range(3):
            df = numbered(spark, first + 5 * part, first + 5 * part + 12, f"{name}{part}", part)
            df.coalesce(1).write.mode("append").parquet(source)
            if table is None:
                table = up.last_updates(df, KEYS, ORDER, "last_modify_ts").withColumnRenamed("_first_seen", "add_ts")
            else:
                table = up.upsert(table, df, KEYS, ORDER)
            for _ in range(2):  # the second finds nothing new
                stream = ingest.read_stream(spark, source, df.schema, files_per_trigger=1)
                ingest.stream_upsert_buckets(stream, out, KEYS, ORDER, str(tmp_path / f"cp-{name}"), buckets=4).awaitTermination()
        table = spark.createDataFrame(table.collect(), table.schema)
    assert show(bk.read_buckets(spark, out)) == show(table)
    assert sorted(bk.manifest(spark, out).batches.values()) == [2, 2]
