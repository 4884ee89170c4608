"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from feedloom.session import estimated_bytes, shared_path

#: Rows and bytes of an Arrow batch: texts may be long, so a batch holds few of them.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the memory of a Python task by bounding its batches."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """The frame as a table in the shared folder, read again: a cut of the lineage that
    outlives any executor, and whose size Catalyst knows. A ``narrow`` table, of a few
    numbers a row, is written in no more files than there are cores."""
    path = shared_path(df.sparkSession, name)
    if narrow:
        df = df.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table up to this size is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The frame, marked for broadcast if its known size allows."""
    return F.broadcast(df) if estimated_bytes(df) <= BROADCAST_BYTES else df


def map_arrow(
    df: DataFrame,
    inputs: Sequence[str],
    keep: Sequence[str],
    outputs: str,
    rows: Callable[[Iterator[list]], Iterable[tuple[list, list | None]]],
) -> DataFrame:
    """Kept columns and new ones, batch by batch.

    ``rows`` gets batches as lists of the input columns (Arrow arrays) and gives for each
    the new columns and, if rows were dropped or repeated, the index of each row's origin.
    Only ``inputs`` and ``keep`` reach Python; kept columns stay Arrow arrays, so ids keep
    every bit. A kept column whose name is an output's gives way to the output.
    """
    made = _parse_datatype_string(outputs)
    keep = [c for c in dict.fromkeys(keep) if c not in made.names]
    source = df.select(
        *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)],
        *[F.col(f"`{c}`").alias(f"__i{i}") for i, c in enumerate(inputs)],
    )
    schema = StructType([*source.schema.fields[: len(keep)], *made.fields])
    types = [f.type for f in to_arrow_schema(made)]
    names, kept = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def columns() -> Iterator[list]:
            for batch in batches:
                held[:] = [batch]
                yield batch.columns[kept:]

        for new, origin in rows(columns()):
            old = held[0].columns[:kept]
            if origin is not None:
                index = pa.array(origin, pa.int64())
                old = [c.take(index) for c in old]
            new = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays([*old, *new], names=names)

    return source.mapInArrow(run, schema).toDF(*keep, *made.names)


class Memo:
    """What was computed for a key, for the keys met last: two generations of at most about
    ``size`` entries. Forgetting costs time only: a key is computed anew."""

    def __init__(self, compute: Callable[[list], list], size: int = 400_000):
        self.compute, self.size = compute, size
        self.young: dict = {}
        self.old: dict = {}

    def values(self, groups: list[list]) -> list[list]:
        """The values of groups of keys, in place of the keys."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        get = young.get
        found = [list(map(get, keys)) for keys in groups]
        holes = [
            (keys, values, [i for i, v in enumerate(values) if v is None])
            for keys, values in zip(groups, found)
            if None in values
        ]
        if holes:
            missing = []
            for k in {keys[i] for keys, _, at in holes for i in at}:
                v = old.get(k)
                if v is None:
                    missing.append(k)
                else:
                    young[k] = v
            if missing:
                young.update(zip(missing, self.compute(missing)))
            for keys, values, at in holes:
                for i in at:
                    values[i] = young[keys[i]]
        return found
