import math

import odd
import pytest
from feedloom.llm import topk
from pyspark.sql import functions as F


def reference(rows, k=5, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i % 50 == 0:
            held = lambda s: max(-(2**63), min(2**63 - 1, s))
            scores = sorted((-held(sum(a * b for a, b in zip(q, v))), j) for other, (j, v) in enumerate(ok) if other != at)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, **limits):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    return sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0, **limits).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    import random

    if small:
        monkeypatch.setattr(topk, "SLICE", 40)
        monkeypatch.setattr(topk, "BLOCK", 2)
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.001, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(260)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(odd.BIG, [0.5] * 6), (7, None), (8, [1.0, None]), (50, [float("nan")]), (None, [1.0]), (9, []), (12, [0.25] * 9), (11, rows[0][1]), (11, rows[0][1])]
    assert found(spark, rows) == reference(rows)


def test_few_rows(spark):
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [-1.0])]) == [(0, 1, 1, -65536)]
    assert found(spark, [(1, [1.0])]) == []
    assert found(spark, []) == []


def test_repeated_queries_have_lists_each(spark):
    twins = [(0, 1, 1, 131072), (0, 2, 0, 65536)]  # a twin is another row
    assert found(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0])]) == sorted(twins * 2)


def test_large_components(spark):
    rows = [(0, [1e9, 2.0]), (1, [1e9, 1.0]), (2, [1e17, 0.0]), (50, [-1e12, 3.0]), (3, [1e300, -1e300])]
    assert found(spark, rows) == reference(rows)
