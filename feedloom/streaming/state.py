"""Stateful stream operators: expiring values and running caps."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from feedloom.streaming.ingest import event_time


def _rank(order: list[str]):
    """Sort key of a row: its order columns, NULLs last."""
    return lambda row: tuple((row[c] is None, row[c]) for c in order)


class _Cap(StatefulProcessor):
    """Counts the rows passed per key and passes rows until the cap."""

    def __init__(self, n: int, order: list[str]):
        self._n, self._order = n, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._passed = handle.getValueState("passed", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = self._passed.get()[0] if self._passed.exists() else 0
        room = self._n - passed
        if room <= 0:
            for _ in rows:
                pass
            return
        out = heapq.nsmallest(room, rows, key=_rank(self._order))
        if out:
            self._passed.update((passed + len(out),))
            yield from out

    def close(self) -> None:
        pass


def _pruned(stream: DataFrame, keys: list[str], order: list[str], n: int, last: bool = False) -> DataFrame:
    """Keep the first (or last) ``n`` rows per key of every Arrow batch.

    Stateless and exact: a row behind ``n`` others of its own batch cannot be among
    the first ``n``. A hot key then reaches its state task as ``n`` rows per batch.
    Rows are taken from the batch as they are, so ids keep every bit.
    """

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranked = pc.sort_indices(
                batch.select(order), sort_keys=[(c, "ascending") for c in order], null_placement="at_end"
            ).to_pylist()
            groups = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            met: Counter = Counter()
            kept = []
            for i in reversed(ranked) if last else ranked:
                met[groups[i]] += 1
                if met[groups[i]] <= n:
                    kept.append(i)
            yield batch.take(pa.array(sorted(kept), pa.int64()))

    return stream.mapInArrow(prune, stream.schema)


def stream_first_n(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], n: int
) -> DataFrame:
    """Pass the first ``n`` rows per key, in order within a micro-batch, over the stream's
    life. Needs the RocksDB state store."""
    keys, order = list(keys), list(order)
    pruned = _pruned(stream, keys, order, n)
    return pruned.groupBy(*keys).transformWithState(
        statefulProcessor=_Cap(n, order),
        outputStructType=stream.schema,
        outputMode="Append",
        timeMode="None",
    )


class _Expiring(StatefulProcessor):
    """Holds the last value of a key until its time to live runs out."""

    def __init__(self, keys: list[str], order: list[str], value: str, ttl_ms: int, held: StructType):
        self._keys, self._order, self._value = keys, order, value
        self._ttl, self._schema = ttl_ms, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", self._schema, ttlDurationMs=self._ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rank, best = _rank(self._order), None
        for row in rows:
            if best is None or rank(row) >= rank(best):
                best = row
        if best is None:
            return
        names = self._schema.names
        before = self._last.get()[names.index(self._value)] if self._last.exists() else None
        now = tuple(best[c] for c in names)
        self._last.update(now)
        yield Row(*self._keys, *names, "previous")(*[best[k] for k in self._keys], *now, before)

    def close(self) -> None:
        pass


def expiring_state(
    stream: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], ttl_seconds: float
) -> DataFrame:
    """Set values per key and get what was there.

    Each micro-batch that sets a key emits the value set last and ``previous``, the
    value held before the batch: NULL if there was none or if ``ttl_seconds`` of
    processing time have passed since it was set. Expired values are swept by the
    state store (RocksDB). ``latest_unexpired`` is the batch twin, by event time. To run
    it over the files that are there and stop, start it in ``no_empty_batches``.
    """
    ttl_ms = int(ttl_seconds * 1000)
    if ttl_ms <= 0:
        raise ValueError("the time to live must be at least a millisecond")
    keys, order = list(keys), list(order)
    fields = list(dict.fromkeys([value, *order]))
    rows = stream.select(*keys, *[c for c in fields if c not in keys])
    schema = rows.schema

    held = StructType([schema[c] for c in schema.names if c not in keys])
    previous = StructField("previous", schema[value].dataType)
    output = StructType([schema[c] for c in keys] + held.fields + [previous])
    return (
        _pruned(rows, keys, order, 1, last=True)
        .groupBy(*keys)
        .transformWithState(
            statefulProcessor=_Expiring(keys, order, value, ttl_ms, held),
            outputStructType=output,
            outputMode="Update",
            timeMode="ProcessingTime",
        )
    )


SET, EXPIRED = "set", "expired"
_AT = "_at"  # event time in milliseconds


class _Sweeping(StatefulProcessor):
    """Holds the last value of a key and a timer for its end; tells of both."""

    def __init__(self, keys: list[str], order: list[str], value: str, ttl_ms: int, held: StructType):
        self._keys, self._order, self._value = keys, [_AT, *order], value
        self._ttl, self._schema = ttl_ms, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", StructType([*self._schema.fields, StructField("expires", LongType())]))

    def _row(self, key: tuple, held: tuple, previous, event: str, at: int) -> Row:
        names = (*self._keys, *self._schema.names, "previous", "event", "at")
        return Row(*names)(*key, *held, previous, event, at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rank, names = _rank(self._order), self._schema.names
        best = max(rows, key=rank, default=None)
        if best is None:
            return
        before = None
        if self._last.exists():
            *held, expires = self._last.get()
            old = dict(zip(names, held))
            if rank(best) < rank(old):
                return  # late: what is held was set after it
            self._handle.deleteTimer(expires)
            if expires <= best[_AT]:
                yield self._row(key, tuple(held), None, EXPIRED, expires)
            else:
                before = old[self._value]
        now = tuple(best[c] for c in names)
        expires = best[_AT] + self._ttl
        self._last.update((*now, expires))
        self._handle.registerTimer(expires)
        yield self._row(key, now, before, SET, best[_AT])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self._last.exists():
            *held, expires = self._last.get()
            if expires == at:
                self._last.clear()
                yield self._row(key, tuple(held), None, EXPIRED, at)

    def close(self) -> None:
        pass


def sweeping_state(
    stream: DataFrame,
    keys: Sequence[str],
    value: str,
    ts: str,
    ttl_seconds: float,
    delay: str = "0 seconds",
    order: Sequence[str] = (),
) -> DataFrame:
    """Values per key that expire by event time, and are seen to.

    Each micro-batch that sets a key emits a row of the value set last (by ``ts``, then
    ``order``): ``event`` is ``set``, ``at`` its time in milliseconds, and ``previous`` the value
    held before the batch, NULL if there was none or ``ttl_seconds`` had passed between the
    two. Each value that runs out emits one row more: ``event`` is ``expired``, ``at`` the time
    at which it did. A timer does that when the watermark (``delay`` behind the newest row)
    is past it, or the next value of the key if it comes first; a value that is replaced in
    time never expires. Rows older than what is held change nothing, nor do rows without a time.
    Needs the RocksDB state store; ``held_keys`` lists the keys.
    """
    ttl_ms = int(ttl_seconds * 1000)
    if ttl_ms <= 0:
        raise ValueError("the time to live must be at least a millisecond")
    keys, order = list(keys), list(order)
    fields = list(dict.fromkeys([value, *order]))
    timed = event_time(stream, ts).where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    rows = timed.select(*keys, *[c for c in fields if c not in keys], ts, F.unix_millis(ts).alias(_AT))
    schema = rows.schema
    held = StructType([schema[c] for c in schema.names if c not in (*keys, ts)])
    told = [
        StructField("previous", schema[value].dataType), StructField("event", StringType()), StructField("at", LongType())
    ]
    output = StructType([schema[c] for c in keys] + held.fields + told)
    found = (
        _pruned(rows, keys, [_AT, *order], 1, last=True)
        .groupBy(*keys)
        .transformWithState(
            statefulProcessor=_Sweeping(keys, order, value, ttl_ms, held),
            outputStructType=output,
            outputMode="Update",
            timeMode="EventTime",
        )
    )
    return found.drop(_AT)


def held_keys(spark: SparkSession, checkpoint: str, pattern: str = "*") -> DataFrame:
    """The keys that a stream of ``expiring_state`` or ``sweeping_state`` holds after its last
    micro-batch, and their values (``key``, ``value``), read from its checkpoint.

    ``pattern`` keeps keys of which a column contains it; asterisks in it are ignored, so
    ``*`` keeps all. A value that has run out stays until it is swept.
    """
    found = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    found = found.select("key", "value")
    part = pattern.replace("*", "")
    if not part:
        return found
    names = [f.name for f in found.schema["key"].dataType.fields]
    texts = F.array(*[F.col("key")[n].cast("string") for n in names])
    return found.where(F.exists(texts, lambda t: F.coalesce(F.contains(t, F.lit(part)), F.lit(False))))
