"""Shards of near equal bytes by histogram sort: splitters first, then one exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from feedloom.llm.common import map_arrow, written

#: Share of a shard by which a splitter may miss its place.
TOLERANCE = 0.005
#: Probes that a round puts into the interval of a splitter, and in the first round for each.
PROBES = 31
#: Rows of a piece at most, about, and at least; pieces that a task of the exchange gets.
PIECE_ROWS = 500_000
FEW_ROWS = 64
PIECES_A_TASK = 4

#: Keys of equal texts share all above these bits. Keys are even, so all are below HIGH - 1.
GROUP = 1 << 32
LOW, HIGH = -(2**63), 2**63


class Splitters:
    """Keys that divide rows where the bytes below them come to given amounts.

    Each target has an interval of keys (from, to] with known bytes and rows below its ends.
    Probes at the edges of groups of equal texts come first, so a group is only divided if
    neither edge of it is near enough.
    """

    def __init__(self, targets: list[float], tolerances: list[float]):
        self.targets, self.tolerances = targets, tolerances
        self.below: dict[int, tuple[int, int]] = {LOW: (0, 0)}
        self.found: dict[int, int] = {}

    def interval(self, i: int, keys: list[int], amounts: np.ndarray) -> tuple[int, int]:
        """The two neighbouring probes that the target lies between."""
        at = int(np.searchsorted(amounts, self.targets[i], side="right"))
        return keys[max(at - 1, 0)], keys[min(at, len(keys) - 1)]

    def probes(self) -> list[int]:
        """Keys to count below next; none when all splitters are found."""
        if HIGH not in self.below:
            n = max(4 * len(self.targets), PROBES)
            return sorted({LOW + (HIGH - LOW) * k // n // GROUP * GROUP for k in range(1, n)} - {LOW}) + [HIGH]
        keys = sorted(self.below)
        amounts = np.array([self.below[k][0] for k in keys], np.float64)
        out: set[int] = set()
        for i, target in enumerate(self.targets):
            if i in self.found:
                continue
            low, high = self.interval(i, keys, amounts)
            (a, rows_a), (b, rows_b) = self.below[low], self.below[high]
            near, miss = (low, target - a) if target - a <= b - target else (high, b - target)
            if miss <= self.tolerances[i] or rows_b - rows_a <= 1 or high - low <= 1:
                self.found[i] = near
                continue
            step = GROUP if (high - 1) // GROUP > low // GROUP else 1
            first, last = low // step + 1, (high - 1) // step
            n = min(PROBES, last - first + 1)
            out.update((first + (last - first + 1) * (2 * k + 1) // (2 * n)) * step for k in range(n))
        return sorted(out - self.below.keys())

    def counted(self, probes: list[int], bins: dict[int, tuple[int, int]]) -> None:
        """Take in the bytes and rows of the keys between each probe and the key before it."""
        known = sorted(self.below)
        at = 0
        for k, probe in enumerate(probes):
            while at + 1 < len(known) and known[at + 1] < probe:
                at += 1
            start = max(known[at], probes[k - 1] if k else LOW)
            n, rows = bins.get(k, (0, 0))
            self.below[probe] = (self.below[start][0] + n, self.below[start][1] + rows)


def _histogram(keys: DataFrame, probes: list[int], known: list[int]) -> dict[int, tuple[int, int]]:
    """Bytes and rows between each probe and the probe or known key before it. A task sends
    one row a probe that has any."""
    edges = np.array([min(p, HIGH - 1) for p in probes], np.int64)
    lows = np.array(known, np.int64)
    before = lows[np.searchsorted(lows, edges, side="left") - 1]
    start = np.maximum(before, np.concatenate([[LOW], edges[:-1]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(edges)), np.int64)
        for batch in batches:
            key, size = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = np.searchsorted(edges, key, side="right")
            inside = at < len(edges)
            at, key, size = at[inside], key[inside], size[inside]
            inside = key >= start[at]
            at, size = at[inside], size[inside]
            np.add.at(sums[0], at, size)
            sums[1] += np.bincount(at, minlength=len(edges))
        at = np.flatnonzero(sums[1])
        columns = [pa.array(at, pa.int32()), pa.array(sums[0][at]), pa.array(sums[1][at])]
        yield pa.RecordBatch.from_arrays(columns, names=["bin", "bytes", "n"])

    parts = keys.select("__key", "size").mapInArrow(run, "bin int, bytes long, n long")
    sums = parts.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    return {r.bin: (r.bytes, r.n) for r in sums.collect()}  # one row a probe


def splitters(keys: DataFrame, parts: int, inner: int, total: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(key, rows below it) of the ``parts`` * ``inner`` - 1 splitters of the columns ``__key``
    and ``size``. Every ``inner``-th divides the shards and is held to the tolerance, a share
    of a shard; the others divide work only and may miss by a quarter of a piece."""
    pieces = parts * inner
    targets = [total * i / pieces for i in range(1, pieces)]
    allowed = [total * (tolerance / parts if i % inner == 0 else 0.25 / pieces) for i in range(1, pieces)]
    search = Splitters(targets, allowed)
    while probes := search.probes():
        search.counted(probes, _histogram(keys, probes, sorted(k for k in search.below if k < HIGH)))
    found = np.maximum.accumulate([search.found[i] for i in range(len(targets))]) if targets else []
    return [(int(k), search.below[int(k)][1]) for k in found]


def shard(
    df: DataFrame,
    shards: int = 40,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    overhead: int = 16,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Kept columns, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` and
    ``grown_shard`` (NULL: the law of this method says nothing of one more shard).

    A row's size is the UTF-8 bytes of its text (NULL: none) and ``overhead``. Rows are sorted
    by a hash of the text and, within equal texts, a hash of the row, and the sorted line is
    cut into ``shards`` runs of nearly equal bytes: a cut misses its place by at most
    ``tolerance`` of a shard or, if a row lies there, half of that row. Rows of equal texts
    stand together, and a group of them is divided only where the cut falls into it and no
    edge of it is near enough. ``slot`` counts the rows of a shard from 0 without gaps.

    Repeated rows have places of their own; NULL and empty texts are equal; with fewer rows
    than shards some are empty; an empty table gives an empty one. Kept columns named as an
    output give way.

    Keys and kept columns are written once. Rounds of histograms count, in every partition,
    the bytes below candidate cuts; only the counts leave the tasks. Then the rows are
    exchanged once, in pieces of a shard that are cut alike, so that neither a shard nor a
    group has to fit in a task; the rows below a piece are known before it is sorted.
    """
    spark = df.sparkSession
    outputs = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keep = tuple(c for c in dict.fromkeys(keep) if c not in outputs)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(
        *[F.col(f"`{c}`") for c in keep],
        (F.octet_length(t) + overhead).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("__text"),
        F.monotonically_increasing_id().alias("__row"),
    )
    group = F.col("__text").bitwiseAND(F.lit(-GROUP))
    key = group.bitwiseOR(F.xxhash64("__row").bitwiseAND(F.lit(GROUP - 2)))
    rows = written(rows.withColumn("__key", key).drop("__text"), "keys")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = -(-max(min(PIECES_A_TASK * tasks, n // FEW_ROWS), n // PIECE_ROWS, 1) // shards)
    found = splitters(rows, shards, inner, total, tolerance) if n else []
    cuts = np.array([min(k, HIGH - 1) for k, _ in found], np.int64)
    below = np.array([0, *(b for _, b in found)], np.int64)

    def place(batches: Iterator[list]):
        for (keys,) in batches:
            piece = np.searchsorted(cuts, keys.to_numpy(zero_copy_only=False), side="right")
            own = piece // inner
            yield [piece.astype(np.int32), own.astype(np.int32), below[piece] - below[own * inner]], None

    kept = [*keep, "size", "text_crc32", "__key", "__row"]
    placed = map_arrow(rows, ["__key"], kept, "__piece int, shard int, __first long", place)
    line = Window.partitionBy("__piece").orderBy("__key", "__row")
    slot = F.col("__first") + F.row_number().over(line) - 1
    return placed.select(
        *[F.col(f"`{c}`") for c in keep],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, shards: int = 40, text: str = "text", **limits) -> None:
    """All columns of the table in one folder a shard (``shard=0`` ...), by ``slot`` within each
    file. Columns named as an output of ``shard`` give way."""
    placed = shard(df, shards, text, tuple(df.columns), **limits).drop("law", "grown_shard")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
