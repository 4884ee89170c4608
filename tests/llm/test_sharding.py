import random
import zlib
from collections import Counter, defaultdict

import odd
import pytest
from feedloom.llm import sharding
from pyspark.sql import functions as F


def checked(rows, shards, texts_of):
    """Slots without gaps, sizes and checksums, cuts as near as the rows allow."""
    by_shard = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by_shard[r.shard].append(r)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    got = Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert got == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts_of)
    return by_shard


def documents(n=700, seed=3):
    rng = random.Random(seed)
    rows = [(i, "word " * rng.choice([1, 5, 40, 300]) + str(i)) for i in range(n)]
    rows += [(n + i, "a copy of one text " * 20) for i in range(n // 2)]
    rows += [(5 * n + i, f"pair {i % 40}" * 9) for i in range(80)]
    rows += [(None, None), (None, ""), (odd.BIG, "x" * 90_000), (1, rows[1][1]), (1, rows[1][1])]
    return rows


@pytest.mark.parametrize("shards, tolerance", [(40, 0.005), (7, 0.0), (1, 0.1), (40, 0.3)])
def test_cuts_are_as_near_as_rows_allow(spark, monkeypatch, shards, tolerance):
    monkeypatch.setattr(sharding, "FEW_ROWS", 8)
    own = documents()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in own], "doc_id long, text string, shard int, `odd name.x` string")
    rows = sharding.shard(df.repartition(5), shards, keep=("doc_id", "shard", "odd name.x"), tolerance=tolerance).collect()
    by_shard = checked(rows, shards, own)
    line = [r for s in sorted(by_shard) for r in sorted(by_shard[s], key=lambda r: r.slot)]
    total = sum(r["size"] for r in line)
    ends, at = {}, 0
    for r in line:
        at += r["size"]
        ends[r.shard] = at
    edges = [0]
    for r in line:
        edges.append(edges[-1] + r["size"])
    below = 0
    for s in range(shards - 1):
        below = ends.get(s, below)
        target = total * (s + 1) / shards
        assert abs(below - target) <= max(tolerance * total / shards, min(abs(e - target) for e in edges)) + 1e-6
    # equal texts stand together, and few groups are divided
    groups = [r.text_crc32 for r in line]
    assert sum(x != y for x, y in zip(groups, groups[1:])) == len(set(groups)) - 1
    places = defaultdict(set)
    for r in line:
        places[r.text_crc32].add(r.shard)
    whole = [c for c, s in places.items() if len(s) > 1 and c != zlib.crc32(("a copy of one text " * 20).encode())]
    assert len(whole) <= shards - 1


def test_a_group_is_divided_only_where_no_edge_is_near(spark):
    rows = [(i, f"text {i // 4} " * 30) for i in range(1600)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4, tolerance=0.02).collect()
    assert Counter(len({r.shard for r in found if r.doc_id // 4 == g}) for g in range(400)) == {1: 400}
    sizes = [sum(r["size"] for r in found if r.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 0.04 * sum(sizes) / 4


def test_one_group_of_all_rows(spark):
    rows = [(i, "the same") for i in range(1000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    assert set(Counter(r.shard for r in found).values()) == {25}


def test_histogram_counts_what_is_below(spark):
    rng = random.Random(8)
    keys = [(rng.choice([2, 4, 6, -8, rng.randrange(-(2**62), 2**62) * 2]), rng.randrange(100)) for _ in range(500)]
    df = spark.createDataFrame(keys, "__key long, size long").repartition(3)
    for parts, inner in ((1, 1), (5, 1), (4, 3), (300, 2)):
        found = sharding.splitters(df, parts, inner, sum(n for _, n in keys), 0.01)
        assert len(found) == parts * inner - 1 and [k for k, _ in found] == sorted(k for k, _ in found)
        for key, below in found:
            assert below == sum(k < key for k, _ in keys)


def test_small_tables(spark):
    assert sharding.shard(odd.empty(spark)).collect() == []
    own = [(1, "a"), (2, None), (3, "ccc")]
    checked(sharding.shard(spark.createDataFrame(own, "doc_id long, text string")).collect(), 40, own)
    checked(sharding.shard(odd.documents(spark)).collect(), 40, [(r.doc_id, r.text) for r in odd.documents(spark).collect()])


def test_written_shards(spark, tmp_path):
    own = documents(200)
    df = spark.createDataFrame(own, "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter(own)
    assert back.select(F.countDistinct("shard")).first()[0] == 6
    assert back.groupBy("shard").agg(F.max("slot") - F.count("*")).distinct().collect()[0][1] == -1
