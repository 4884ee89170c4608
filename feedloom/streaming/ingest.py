"""Streaming ingest, continuous upsert, repeat filter, and running counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Optional, Union

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from feedloom.functions.text import tokens
from feedloom.operators.words import drop_stopwords
from feedloom.sinks.buckets import upsert_buckets
from feedloom.sinks.upsert import append_updates, run_of

BatchFn = Callable[[DataFrame, int], None]


def read_stream(
    spark: SparkSession,
    path: str,
    schema: Union[str, StructType],
    file_format: str = "parquet",
    files_per_trigger: Optional[int] = None,
    **options: str,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


@contextmanager
def no_empty_batches(spark: SparkSession) -> Iterator[None]:
    """Start queries inside to run without empty micro-batches.

    A query whose state expires by processing time would otherwise go on with empty
    batches for ever, and a run over the files that are there would never end.
    """
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_ingest(
    stream: DataFrame, fn: BatchFn, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Hand every micro-batch to ``fn(df, batch_id)`` as it arrives."""
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_upsert(
    stream: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str],
    checkpoint: str,
    seen: str = "last_modify_ts",
    available_now: bool = True,
) -> StreamingQuery:
    """Continuous upsert, merged on read.

    A micro-batch costs its own size, not the table's, and a repeated batch replaces
    itself; a stream with a new checkpoint is a run of its own, after those before it.
    ``sinks.upsert.read_upserts`` gives the table.
    """
    keys, order = list(keys), list(order)
    run = run_of(stream.sparkSession, path, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_updates(batch, path, keys, order, batch_id, seen, run)

    return stream_ingest(stream, write, checkpoint, available_now)


def stream_upsert_buckets(
    stream: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str],
    checkpoint: str,
    seen: str = "last_modify_ts",
    buckets: int = 256,
    available_now: bool = True,
) -> StreamingQuery:
    """Continuous upsert into a bucketed table, which is up to date after each micro-batch.

    A micro-batch rewrites the buckets that its keys fall into; one that is handed over
    again is known by its number and changes nothing. Other streams and batch writers may
    upsert into the same table meanwhile.
    """
    keys, order = list(keys), list(order)

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_buckets(batch, path, keys, order, seen, buckets, checkpoint, batch_id)

    return stream_ingest(stream, write, checkpoint, available_now)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant; zone-less timestamps are read as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_dedupe(
    stream: DataFrame, keys: Sequence[str], ts: str, ttl: str, salts: int = 1
) -> DataFrame:
    """Pass the first row of a key; ignore repeats until ``ttl`` of event time has passed.

    ``salts`` above 1 is for streams with hot keys: repeats are first dropped within
    salted pieces of a key, so its final task sees at most one row per piece.
    """
    timed = event_time(stream, ts).withWatermark(ts, ttl)
    if salts > 1:
        piece = F.pmod(F.xxhash64(*stream.columns), F.lit(salts))
        salted = timed.withColumn("_piece", piece)
        timed = salted.dropDuplicatesWithinWatermark([*keys, "_piece"]).drop("_piece")
    return timed.dropDuplicatesWithinWatermark(list(keys))


def stream_word_freq(
    stream: DataFrame,
    text_col: str,
    stop: Sequence[str] = (),
    custom: Sequence[str] = (),
    tokenizer: Optional[Callable[[Column], Column]] = None,
) -> DataFrame:
    """Running word counts (output mode complete or update): only new text is counted."""
    split = tokenizer or (lambda c: tokens(c, custom))
    words = stream.select(F.explode(split(F.col(text_col))).alias("word"))
    return drop_stopwords(words, stop).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def stream_daily_counts(
    stream: DataFrame, ts: str, keys: Sequence[str], delay: str = "1 day"
) -> DataFrame:
    """Rows per day and key; a day is final ``delay`` after its end, later rows are dropped."""
    day = F.window(ts, "1 day").alias("_day")
    counts = (
        event_time(stream, ts)
        .withWatermark(ts, delay)
        .groupBy(day, *keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.select(F.to_date("_day.start").alias("day"), *keys, "n")
