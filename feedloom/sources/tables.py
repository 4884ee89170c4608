"""Tables, seed lists and files the sinks wrote."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any, Optional, Union

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from feedloom.functions.text import last_segment, note_ref, segment_from_end, url_kind
from feedloom.operators.filters import split_keywords


def read_pages(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """HTML pages: a Parquet table (``page_id, url, html``) or a folder of HTML files."""
    if not whole_files:
        return spark.read.parquet(path)
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )


def read_json_array(
    spark: SparkSession, path: str, schema: Union[str, StructType], per_line: bool = False
) -> DataFrame:
    """Rows of JSON arrays: one array per file, or one per line, which splits large files.

    The schema is declared, never inferred.
    """
    return spark.read.option("multiLine", not per_line).schema(schema).json(path)


def read_table(spark: SparkSession, sql: str, args: Optional[Mapping[str, Any]] = None) -> DataFrame:
    """A parametrised query; markers such as ``:name`` are bound, never spliced."""
    return spark.sql(sql, args=dict(args or {}))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: Optional[str] = None,
    bounds: Optional[tuple[Any, Any]] = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A database table, read in ranges of ``partition_column`` when one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column is not None:
        low, high = bounds
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(low),
            upperBound=str(high),
            numPartitions=str(partitions),
        )
    return reader.load()


def lookup(df: DataFrame, **key: Any) -> DataFrame:
    """Rows whose columns equal the given values (pushed to the scan)."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in key.items()]))


def first_row(df: DataFrame) -> DataFrame:
    return df.limit(1)


def seeds(spark: SparkSession, values: Union[str, Sequence[str]], kind: str) -> DataFrame:
    """A seed list as rows. ``kind``: keyword, id, url, note_url or zhihu_url.

    Keywords may be one comma-separated text. URLs also give the id they name.
    """
    listed = split_keywords(values) if kind == "keyword" else list(dict.fromkeys(values))
    names = {"keyword": "source_keyword", "id": "id"}
    df = spark.createDataFrame([(v,) for v in listed], f"{names.get(kind, 'url')} string")
    if kind in names:
        return df
    if kind == "url":
        return df.withColumn("id", last_segment("url"))
    if kind == "note_url":
        return df.withColumn("_ref", note_ref("url")).select("url", "_ref.*")
    if kind == "zhihu_url":
        question = F.when(url_kind("url") == "answer", segment_from_end("url", 3))
        return df.select(
            "url",
            last_segment("url").alias("id"),
            url_kind("url").alias("content_type"),
            question.alias("question_id"),
        )
    raise ValueError(f"unknown seed kind {kind!r}")


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files below a folder; their contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    return files.select(F.substring_index("path", "/", -1).alias("name"))
