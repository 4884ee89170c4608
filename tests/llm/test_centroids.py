import hashlib
import math
import random

import numpy as np
import odd
import pytest
from feedloom.llm import centroids


def reference(rows, k=16, rounds=3, scale=64, size=64):
    held = lambda x: max(-centroids.LIMIT, min(centroids.LIMIT, math.floor(max(-1e300, min(1e300, scale * x)))))
    kept = [
        (i, [held(x) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))
    points = [v for _, v in first[:k]]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))

    def assign():
        return [min((apart(v, c), j) for j, c in enumerate(points)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(points)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if mine:
                points[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    inertia = [sum(d for d, c in own if c == j) for j in range(len(points))]
    top = lambda x: min(x, 2**63 - 1)
    total = sum(sum(top(d) for d, c in own if c == j) for j in range(len(points)))
    inertia = [sum(top(d) for d, c in own if c == j) for j in range(len(points))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in points]
    return sorted(
        ((i, c, top(d), top(inertia[c]), top(total), sha[c]) for (i, _), (d, c) in zip(kept, own)), key=str
    )


def found(spark, rows, **limits):
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, cluster string, inertia int")
    out = centroids.cluster(df.repartition(3), **limits)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def vectors(n, size, seed=4, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    return [(i, [m + rng.gauss(0, 0.2) * spread for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("size, k", [(64, 16), (3, 4), (1, 2)])
def test_against_brute_force(spark, size, k):
    rows = vectors(150, size)
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(i, rows[i][1]) for i in range(3)]  # repeated rows
    rows += [(odd.BIG, rows[0][1]), (None, rows[1][1]), (2000, None), (2001, []), (2002, [1.0] * (size + 1))]
    rows += [(2003, [float("nan")] * size), (2004, [None] * size), (2005, [float("inf")] * size)]
    assert found(spark, rows, k=k, size=size) == reference(rows, k, size=size)


def test_ties_and_few_vectors(spark):
    grid = [(i, [float(i % 3), float(i % 2)]) for i in range(12)]
    for k in (1, 4, 16, 40):
        assert found(spark, grid, k=k, size=2) == reference(grid, k, size=2)
    same = [(i, [0.5, 0.5]) for i in range(20)]
    assert found(spark, same, size=2) == reference(same, size=2)
    assert found(spark, [(7, [0.5, 0.5])], size=2) == reference([(7, [0.5, 0.5])], size=2)
    assert found(spark, [(None, [1.0, 2.0]), (None, [3.0, 4.0])], size=2) == reference([(None, [1.0, 2.0]), (None, [3.0, 4.0])], size=2)
    assert found(spark, [(1, None)], size=2) == []
    assert found(spark, [], size=2) == []


def test_large_components(spark):
    rows = vectors(60, 4) + [(100 + i, [x * 10.0 ** (3 * i) for x in v]) for i, (_, v) in enumerate(vectors(12, 4, seed=9))]
    rows += [(200, [1e300, -1e300, 1e308, 0.0]), (201, [1e17, 1e17, 1e17, 1.0])]
    assert found(spark, rows, k=6, size=4) == reference(rows, 6, size=4)


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(1)
    for size in (1, 2, 64):
        for reach in (5, 1000, 10**9, 2**61):
            table = rng.integers(-reach, reach, (60, size))
            table[10:20] = table[:10]
            points = [list(map(int, r)) for r in table[:8]]
            some = [list(map(int, r)) for r in table[30:40]] + points[:3]
            chosen = centroids.pivots(points)
            cached = centroids.distances(table, chosen)
            least = centroids.Bounds(chosen, some).squared(cached)
            for c, point in enumerate(some):
                exact = [sum((int(a) - b) ** 2 for a, b in zip(v, point)) for v in table]
                assert all(b <= d for b, d in zip(least[:, c], exact))


def test_bounds_spare_work():
    rows = np.floor(64 * np.array([v for _, v in vectors(2000, 64)])).astype(np.int64)
    start = [list(map(int, r)) for r in rows[:16]]
    points = centroids.pivots(start)
    cached = centroids.distances(rows, points)
    _, _, work = centroids.nearest(rows, cached, start, centroids.Bounds(points, start))
    assert work < 0.8 * rows.shape[0] * len(start)
