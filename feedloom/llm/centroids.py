"""Centroid clustering in whole numbers, pruned by Ptolemaic bounds from cached pivot distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import map_arrow, written

#: Fixed points whose distances are cached with every vector; all pairs of them give bounds.
PIVOTS = 6
#: Components beyond this size count as this; distances beyond 64 bits as the largest.
LIMIT = 2**62
MOST = 2**63 - 1
#: Share of a sum of products by which rounding can shift a bound, many times over.
SLACK = 2.0**-46


def squares(vectors: np.ndarray, point: list[int]) -> np.ndarray:
    """Exact squared distances of integer vectors (rows) from a point: in doubles where no
    intermediate value can lose a bit, in Python's integers otherwise."""
    most = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)), *map(abs, point), 0)
    if 4 * most * most * max(len(point), 1) < 2**53:
        apart = vectors.astype(np.float64) - np.array(point, np.float64)
        return np.einsum("ij,ij->i", apart, apart).astype(np.int64)
    apart = vectors.astype(object) - np.array(point, object)
    return (apart * apart).sum(axis=1) if len(apart) else np.zeros(0, object)


def roots(values: np.ndarray) -> np.ndarray:
    return np.sqrt(values.astype(np.float64))


def distances(vectors, points: list[list[int]]) -> np.ndarray:
    """Distances of vectors (rows) from points (columns)."""
    if not len(vectors) or not points:
        return np.zeros((len(vectors), len(points)))
    table = np.asarray(vectors, np.int64)
    return np.stack([roots(squares(table, p)) for p in points], axis=1)


def pivots(points: list[list[int]], n: int = PIVOTS) -> list[list[int]]:
    """Up to ``n`` different points far from each other: each the farthest from those before."""
    if not points:
        return []
    table = np.array(points, np.int64)
    chosen = [0]
    nearest = squares(table, points[0])
    while len(chosen) < n and max(nearest) > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, squares(table, points[chosen[-1]]))
    return [points[i] for i in chosen]


class Bounds:
    """Lower bounds of distances from centroids.

    For any four points Ptolemy's inequality gives d(x,c) d(p,q) >= |d(x,p) d(c,q) - d(x,q) d(c,p)|,
    so two cached distances of x bound its distance from each c. Each bound is lowered by
    more than the rounding of its terms can have raised it.
    """

    def __init__(self, points: list[list[int]], centroids: list[list[int]]):
        self.own = distances(centroids, points)
        apart = distances(points, points)
        self.pairs = [(p, q, apart[p, q]) for p, q in combinations(range(len(points)), 2)]

    def squared(self, cached: np.ndarray) -> np.ndarray:
        """Bounds of squared distances: a row a vector, a column a centroid."""
        best = np.zeros((len(cached), len(self.own)))
        for p, q, apart in self.pairs:
            x = cached[:, p, None] * self.own[:, q]
            y = cached[:, q, None] * self.own[:, p]
            np.maximum(best, (np.abs(x - y) - SLACK * (x + y)) / apart, out=best)
        return best * best * (1 - SLACK)


def nearest(vectors: np.ndarray, cached: np.ndarray, centroids: list[list[int]], bounds: Bounds):
    """(centroid, squared distance, distances worked out) of each vector; ties go to the
    smaller number. The centroid with the smallest bound comes first; of the others only
    those whose bound does not exceed the best distance so far are looked at."""
    least = bounds.squared(cached)
    first = np.argmin(least, axis=1)
    own = first.astype(np.int64)
    best = np.zeros(len(vectors), object)
    for c, point in enumerate(centroids):
        at = np.flatnonzero(first == c)
        best[at] = squares(vectors[at], point)
    work = len(vectors)
    for c, point in enumerate(centroids):
        at = np.flatnonzero((least[:, c] <= best.astype(np.float64) * (1 + SLACK)) & (first != c))
        found = squares(vectors[at], point)
        work += len(at)
        closer = ((found < best[at]) | ((found == best[at]) & (c < own[at]))).astype(bool)
        at = at[closer]
        best[at], own[at] = found[closer], c
    return own, best, work


def _matrix(column: pa.Array, size: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), size)


def _sums(table: DataFrame, size: int, points: list, centroids: list) -> dict[int, tuple[int, list[int]]]:
    """Vectors of each cluster and the sums of their components. A task sends one row a
    component of a cluster."""
    bounds = Bounds(points, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * len(centroids)
        sums = [np.zeros(size, object) for _ in centroids]
        for batch in batches:
            vectors = _matrix(batch.column(0), size, np.int64)
            own, _, _ = nearest(vectors, _matrix(batch.column(1), len(points), np.float64), centroids, bounds)
            wide = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0))) * max(len(vectors), 1) >= 2**62
            for c in np.unique(own).tolist():
                mine = vectors[own == c]
                counts[c] += len(mine)
                sums[c] += (mine.astype(object) if wide else mine).sum(axis=0)
        rows = [(c, n, i, s) for c, n in enumerate(counts) if n for i, s in enumerate(sums[c])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int32()),
                pa.array([Decimal(int(r[3])) for r in rows], pa.decimal128(38, 0)),
            ],
            names=["cluster", "n", "i", "s"],
        )

    rows = table.select("__e", "__d").mapInArrow(run, "cluster int, n long, i int, s decimal(38,0)")
    added = rows.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in added.orderBy("cluster", "i").collect():  # centroids times components
        found.setdefault(r.cluster, (r.n, []))[1].append(int(r.s))
    return found


def cluster(
    df: DataFrame,
    k: int = 16,
    rounds: int = 3,
    scale: int = 64,
    size: int = 64,
    seed: int = 1,
    id: str = "vec_id",
    vector: str = "embedding",
    keep: tuple[str, ...] = ("vec_id",),
) -> DataFrame:
    """Kept columns, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256`` of every vector of ``size`` components.

    A component x counts as floor(scale * x). The first centroids are the ``k`` vectors with
    the smallest SHA-256 of ``seed:id``, in that order; equal ids go by their components,
    rows without an id come last. Each round every vector goes to its nearest centroid
    (squared distance, ties to the smaller number) and every centroid that has vectors moves
    to the floor of their mean, component by component; at the end all are assigned once more.

    NULL vectors, vectors of another length and those with a NULL or non-finite component are
    left out; repeated rows are vectors of their own; with fewer than ``k`` vectors there are
    fewer centroids; an empty table gives an empty one. Components beyond 2^62 count as that,
    distances and inertias beyond 64 bits as the largest number. Kept columns named as an
    output give way.

    Vectors and their distances from a few pivots, chosen among the first centroids, are
    written once; each round only sums of clusters leave the tasks.
    """
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    held = F.transform(
        v, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * x.cast("double"))))
    )
    keep = tuple(c for c in dict.fromkeys(keep) if c not in ("__e", "__d"))
    usable = df.filter(v.isNotNull() & (F.size(v) == size) & fine)
    source = usable.select(*[F.col(f"`{c}`") for c in keep], held.alias("__e"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id}`").cast("string")), 256)
    order = usable.select(hashed.alias("h"), F.col(f"`{id}`").alias("id"), held.alias("e"))
    order = order.orderBy(F.asc_nulls_last("h"), "id", "e").limit(k)
    centroids = [list(r.e) for r in order.collect()]  # k rows
    points = pivots(centroids)

    def measure(batches: Iterator[list]):
        for (vectors,) in batches:
            cached = distances(_matrix(vectors, size, np.int64), points)
            offsets = (np.arange(len(cached) + 1) * len(points)).astype(np.int32)
            yield [vectors, pa.ListArray.from_arrays(offsets, pa.array(cached.ravel()))], None

    table = written(map_arrow(source, ["__e"], list(keep), "__e array<long>, __d array<double>", measure), "vectors")
    for _ in range(rounds):
        for c, (n, sums) in _sums(table, size, points, centroids).items():
            centroids[c] = [s // n for s in sums]
    bounds = Bounds(points, centroids)

    def assign(batches: Iterator[list]):
        for vectors, cached in batches:
            own, best, _ = nearest(
                _matrix(vectors, size, np.int64), _matrix(cached, len(points), np.float64), centroids, bounds
            )
            yield [own.astype(np.int32), [min(int(d), MOST) for d in best]], None

    columns = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    keep = tuple(c for c in keep if c not in columns)
    found = written(map_arrow(table, ["__e", "__d"], list(keep), "cluster int, distance long", assign), "assigned")
    added = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    inertia = {r.cluster: int(r.d) for r in added.collect()}  # k rows
    total = min(sum(inertia.values()), MOST)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(c, min(d, MOST), total, digest(centroids[c])) for c, d in sorted(inertia.items())]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    facts = df.sparkSession.createDataFrame(facts, schema)
    return found.join(F.broadcast(facts), "cluster").select(*[F.col(f"`{c}`") for c in keep], *columns)
