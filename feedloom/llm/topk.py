"""Exact top-k search by inner product, term at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Vectors of a slice, queries of a block, queries whose scores are held at once. Every
#: vector is copied once a block and every query once a slice, so tiles are square.
SLICE = 8192
BLOCK = 8192
HELD = 64


def quantised(vector: pa.ChunkedArray, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors as a matrix; shorter vectors end in zeros."""
    flat = pa.concat_arrays(vector.chunks) if vector.num_chunks else pa.array([], vector.type)
    size = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(scale * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(size), size.max(initial=0)))
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


def score_type(queries: np.ndarray, vectors: np.ndarray):
    """The narrowest type that holds every score; Python's integers beyond 64 bits."""
    most = [float(np.abs(m).max(initial=0)) for m in (queries, vectors)]
    bound = most[0] * most[1] * max(queries.shape[1], 1)
    if max(bound, *most) < 2**31:
        return np.int32
    return np.int64 if max(bound, *most) < 2**62 else object


def scores(postings: list, weights: np.ndarray, n: int, kind) -> np.ndarray:
    """Scores of ``n`` vectors (rows) for queries: one term after the other scatters its
    postings, weighted by the queries that have it, into the dense array."""
    out = np.zeros((n, len(weights)), kind)
    for term, (at, values) in enumerate(postings):
        column = weights[:, term]
        own = np.flatnonzero(column)
        if not len(own) or not len(at):
            continue
        if len(own) == len(column):
            out[at] += values[:, None] * column
        else:
            out[np.ix_(at, own)] += values[:, None] * column[own]
    return out


def best(found: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of each query's k best: the larger score, then the earlier vector.
    ``own`` marks pairs that take no part."""
    out_q, out_v = [], []
    for q in range(found.shape[1]):
        free = np.flatnonzero(~own[:, q])
        line = found[free, q]
        if len(free) > k:
            kth = np.partition(line, len(line) - k)[len(line) - k]
            above = np.flatnonzero(line > kth)
            level = np.flatnonzero(line == kth)[: k - len(above)]
            free = free[np.concatenate([above, level])]
        out_v.append(free)
        out_q.append(np.full(len(free), q))
    return np.concatenate(out_q), np.concatenate(out_v)


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each query row the ``k`` other rows
    with the largest inner product of floor(scale * x), ties to the smaller id.

    Rows without an id, and vectors that are NULL or hold a NULL or non-finite component,
    take no part; an empty vector scores 0; shorter vectors end in zeros. Repeated rows are
    candidates each, also for each other, and repeated query rows have a list each. A query has fewer rows where
    there are fewer candidates, none if there is none. Scores beyond 64 bits count as the
    largest 64-bit value of their sign.

    Queries are cut into blocks and vectors into slices of bounded size; each block meets
    each slice in a task of its own, and the best of the slices are merged.
    """
    usable = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    known = F.col(id).isNotNull() & F.col(vector).isNotNull() & usable
    asks = F.coalesce(is_query, F.lit(False))
    # numbered once for both sides: a query is not its own candidate
    rows = df.select(F.col(id).alias("vec_id"), F.col(vector).alias("v"), asks.alias("asks"), known.alias("known"))
    rows = rows.withColumn("n", F.monotonically_increasing_id()).filter("known").drop("known")
    count = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks = max(1, -(-count.q // BLOCK))
    cores = df.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-count.n // SLICE), min(-(-cores // blocks), -(-count.n // HELD)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "v", "n")
    rows = rows.select("vec_id", "v", "n")
    rows = rows.withColumn("s", (F.col("n") % slices).cast("int")).withColumn("b", numbers(blocks))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")).withColumn("s", numbers(slices))

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids = vectors["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, own = ids[order], vectors["n"].to_numpy()[order]
        matrix = quantised(vectors["v"], scale)[order]
        asked_ids = queries["query_id"].to_numpy()
        asked_n = queries["n"].to_numpy()
        weights = quantised(queries["v"], scale)
        terms = min(matrix.shape[1], weights.shape[1])
        matrix, weights = matrix[:, :terms], weights[:, :terms]
        kind = score_type(weights, matrix)
        exact = kind if kind is not object else (lambda m: np.vectorize(int, otypes=[object])(m))
        matrix, weights = (m.astype(kind) if kind is not object else exact(m) for m in (matrix, weights))
        postings = []
        for term in range(terms):
            at = np.flatnonzero(matrix[:, term])
            postings.append((at, matrix[at, term]))
        parts = []
        for a in range(0, len(asked_ids), HELD):
            found = scores(postings, weights[a : a + HELD], len(ids), kind)
            if kind is object:
                found = np.clip(found, -(2**63), 2**63 - 1).astype(np.int64)
            q, v = best(found, own[:, None] == asked_n[a : a + HELD], k)
            score = found[v, q]
            parts.append((asked_n[a + q], asked_ids[a + q], ids[v], score.astype(np.int64)))
        columns = [np.concatenate(c) if parts else np.array([], np.int64) for c in zip(*parts)] or [[]] * 4
        return pa.table(dict(zip(("n", "query_id", "vec_id", "score"), (pa.array(c, pa.int64()) for c in columns))))

    met = rows.withColumn("vec_id", F.col("vec_id").cast("long")).groupBy("b", "s").cogroup(
        asked.withColumn("query_id", F.col("query_id").cast("long")).groupBy("b", "s")
    )
    found = met.applyInArrow(meet, "n long, query_id long, vec_id long, score long")
    window = Window.partitionBy("n", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
