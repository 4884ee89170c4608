"""CSV, JSON and table writers, the sink switch, and the output layout."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any, Optional

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from feedloom.functions.nested import join_list, map_json
from feedloom.schemas import CANONICAL, struct

LAYOUT = ("platform", "run_type", "role", "ingest_date")


def flattened(df: DataFrame) -> DataFrame:
    """Lists as comma-joined text, maps and structs as JSON text."""

    def flat(name: str, kind: DataType) -> Column:
        if isinstance(kind, ArrayType) and not isinstance(kind.elementType, (StructType, ArrayType)):
            return join_list(name).alias(name)
        if isinstance(kind, MapType):
            return map_json(name).alias(name)
        if isinstance(kind, (ArrayType, StructType)):
            return F.to_json(name).alias(name)
        return F.col(name)

    return df.select(*[flat(f.name, f.dataType) for f in df.schema.fields])


def with_layout(
    df: DataFrame, platform: str, run_type: str, role: str, ingest_date: Optional[str] = None
) -> DataFrame:
    """Add the layout columns that become partition folders."""
    day = F.current_date() if ingest_date is None else F.lit(ingest_date).cast("date")
    values = (F.lit(platform), F.lit(run_type), F.lit(role), day)
    return df.withColumns(dict(zip(LAYOUT, values)))


def output_path(
    root: str, platform: str, run_type: str, role: str, date: str, ext: str, run: Optional[int] = None
) -> str:
    """``<root>/<platform>/[<run>_]<run_type>_<role>_<date>.<ext>``."""
    prefix = "" if run is None else f"{run}_"
    return f"{root}/{platform}/{prefix}{run_type}_{role}_{date}.{ext}"


def write_csv(
    df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()
) -> None:
    """CSV files, each with its header; quotes inside values are doubled."""
    writer = (
        flattened(df)
        .write.mode(mode)
        .option("header", True)
        .option("quoteAll", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
    )
    writer.partitionBy(*partition_by).csv(path) if partition_by else writer.csv(path)


def write_json(
    df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()
) -> None:
    """JSON lines; appending never rereads what is there."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    writer.partitionBy(*partition_by).json(path) if partition_by else writer.json(path)


def append_table(df: DataFrame, table: str) -> None:
    """Append rows; columns are matched by name."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        order = spark.table(table).columns
        df.select(*order).write.mode("append").insertInto(table)
    else:
        df.write.saveAsTable(table)


def append_parquet(
    df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()
) -> None:
    writer = df.write.mode(mode)
    writer.partitionBy(*partition_by).parquet(path) if partition_by else writer.parquet(path)


def write_bucketed(
    df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: Optional[str] = None
) -> None:
    """A table laid out by its join key: tables bucketed alike are joined without a shuffle.

    Content and comment tables bucketed by content id are the case in point. Rows are
    gathered first, so each bucket is one file. Not for keys that own a large share of
    the rows: a bucket is read by one task (``balanced_join`` splits such keys).
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def _upsert_sink(df: DataFrame, path: str, keys: Sequence[str], order: str, **options: Any) -> None:
    from feedloom.sinks.upsert import upsert_path

    upsert_path(df, path, keys, order, **options)


WRITERS: Mapping[str, Callable[..., None]] = {
    "csv": write_csv,
    "json": write_json,
    "db": _upsert_sink,
    "sqlite": _upsert_sink,
    "parquet": append_parquet,
}


def sink(df: DataFrame, option: str, **options: Any) -> None:
    """Write by option name: csv and json append, db and sqlite upsert by key."""
    if option not in WRITERS:
        raise ValueError(f"unknown sink {option!r}, expected one of {sorted(WRITERS)}")
    WRITERS[option](df, **options)


def evolve(
    df: DataFrame, schema: StructType, defaults: Optional[Mapping[str, Any]] = None
) -> DataFrame:
    """Give old data the columns of a newer schema; absent or NULL values become defaults.

    Columns the schema does not know are kept at the end.
    """
    defaults = defaults or {}

    def column(f) -> Column:
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType))
        return value.alias(f.name)

    known = set(schema.names)
    return df.select(*[column(f) for f in schema.fields], *[c for c in df.columns if c not in known])


def append_evolved(
    old: DataFrame, new: DataFrame, defaults: Optional[Mapping[str, Any]] = None
) -> DataFrame:
    """Old and new rows together, columns the old rows lack filled with defaults."""
    both = old.unionByName(new, allowMissingColumns=True)
    for name, value in (defaults or {}).items():
        both = both.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return both


def init_tables(spark: SparkSession, database: str) -> list[str]:
    """Drop and create the canonical tables of a database, partitioned by platform."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    made = []
    for role, (ddl, _) in CANONICAL.items():
        name = f"`{database}`.`{role}`"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in struct(ddl).fields if f.name != "platform"
        )
        spark.sql(
            f"CREATE TABLE {name} ({columns}, `platform` string) "
            "USING parquet PARTITIONED BY (`platform`)"
        )
        made.append(f"{database}.{role}")
    return made
