"""Functions over arrays, maps, structs and JSON texts."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Union

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

ColumnOrName = Union[Column, str]


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- default chains -------------------------------------------------------


def text_or(*candidates: ColumnOrName) -> Column:
    """First candidate that is neither NULL nor '' (the last one is taken as it is)."""
    *head, last = [col(c) for c in candidates]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in head], last)


def number_or_zero(c: ColumnOrName) -> Column:
    return F.coalesce(col(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def first_nonzero(*candidates: ColumnOrName) -> Column:
    *head, last = [col(c) for c in candidates]
    return F.coalesce(*[F.nullif(c, F.lit(0).cast("bigint")) for c in head], last)


# --- arrays ---------------------------------------------------------------


def item(arr: ColumnOrName, i: int) -> Column:
    return F.try_element_at(col(arr), F.lit(i))


def second(arr: ColumnOrName) -> Column:
    return item(arr, 2)


def last_of_many(arr: ColumnOrName) -> Column:
    """Last element when there are two or more."""
    return F.when(F.size(col(arr)) > 1, item(arr, -1))


def first_filled(*arrays: ColumnOrName) -> Column:
    """First array that has elements."""
    return F.coalesce(*[F.when(F.size(col(a)) > 0, col(a)) for a in arrays])


def first_match(arr: ColumnOrName, predicate: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(col(arr), predicate), F.lit(1))


def take(arr: ColumnOrName, n: int) -> Column:
    return F.slice(col(arr), 1, n)


def or_empty(arr: ColumnOrName, element: str) -> Column:
    return F.coalesce(col(arr), F.array().cast(f"array<{element}>"))


def join_list(arr: ColumnOrName) -> Column:
    """Comma-joined elements, NULL elements as '', '' for a NULL array."""
    filled = F.transform(col(arr), lambda x: F.coalesce(x.cast("string"), F.lit("")))
    return F.coalesce(F.array_join(filled, ","), F.lit(""))


def largest(arr: ColumnOrName, size: str = "size", value: str = "url") -> Column:
    """``value`` of the element with the largest ``size``; the first wins ties; '' if none."""
    start = F.struct(F.lit("").alias("value"), F.lit(-1).cast("bigint").alias("size"))

    def keep(best: Column, x: Column) -> Column:
        bigger = F.coalesce(x[size].cast("bigint") > best["size"], F.lit(False))
        return F.when(
            bigger,
            F.struct(
                F.coalesce(x[value], F.lit("")).alias("value"),
                x[size].cast("bigint").alias("size"),
            ),
        ).otherwise(best)

    best = F.aggregate(col(arr), start, keep)
    return F.coalesce(best["value"], F.lit(""))


def zip_columns(left: ColumnOrName, right: ColumnOrName) -> Column:
    """Pair two lists by position."""
    return F.arrays_zip(col(left).alias("left"), col(right).alias("right"))


def present(c: ColumnOrName) -> Column:
    """An array of the value, empty for NULL. Exploding it drops NULL rows in place:
    a filter would be pushed below the projection that parsed the value and have it
    parsed twice."""
    return F.array_compact(F.array(col(c)))


# --- maps -----------------------------------------------------------------


def entries_to_map(arr: ColumnOrName, key: str, value: str) -> Column:
    """Array of structs to a map; entries without key dropped, the last key wins."""
    usable = F.filter(col(arr), lambda e: e[key].isNotNull())
    return F.map_from_entries(F.transform(usable, lambda e: F.struct(e[key], e[value])))


def typed_value(arr: ColumnOrName, name: str, kind: str = "type", value: str = "count") -> Column:
    """``value`` of the last element whose ``kind`` is ``name``."""
    return F.try_element_at(F.filter(col(arr), lambda e: e[kind] == F.lit(name)), F.lit(-1))[value]


def first_map_value(m: ColumnOrName) -> Column:
    return F.try_element_at(F.map_values(col(m)), F.lit(1))


def map_json(m: ColumnOrName) -> Column:
    """Map as JSON text; '{}' for NULL. Non-ASCII text stays readable."""
    return F.coalesce(F.to_json(col(m), {"ignoreNullFields": "false"}), F.lit("{}"))


# --- names ----------------------------------------------------------------


def snake_case(name: str) -> str:
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    return spaced.replace("-", "_").lower()


def snake_schema(data_type: DataType) -> DataType:
    """The same type with every struct field in snake case, at any depth."""
    if isinstance(data_type, StructType):
        return StructType(
            [
                StructField(snake_case(f.name), snake_schema(f.dataType), f.nullable)
                for f in data_type.fields
            ]
        )
    if isinstance(data_type, ArrayType):
        return ArrayType(snake_schema(data_type.elementType), data_type.containsNull)
    if isinstance(data_type, MapType):
        return MapType(
            data_type.keyType, snake_schema(data_type.valueType), data_type.valueContainsNull
        )
    return data_type


def rename_snake(c: ColumnOrName, data_type: DataType) -> Column:
    """Rename nested fields by a cast: positions stay, only names change."""
    return col(c).cast(snake_schema(data_type))


def camel_case(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part[:1].upper() + part[1:] for part in rest)


def camel_schema(data_type: DataType) -> DataType:
    """The same type with every struct field in camel case, at any depth."""
    if isinstance(data_type, StructType):
        return StructType(
            [StructField(camel_case(f.name), camel_schema(f.dataType)) for f in data_type.fields]
        )
    if isinstance(data_type, ArrayType):
        return ArrayType(camel_schema(data_type.elementType))
    if isinstance(data_type, MapType):
        return MapType(data_type.keyType, camel_schema(data_type.valueType))
    return data_type


def fill(first: Column, second: Column, data_type: DataType) -> Column:
    """``first`` with its NULLs, also those inside structs, taken from ``second``."""
    if not isinstance(data_type, StructType):
        return F.coalesce(first, second)
    fields = [fill(first[f.name], second[f.name], f.dataType).alias(f.name) for f in data_type.fields]
    return F.when(first.isNotNull() | second.isNotNull(), F.struct(*fields))


def parse_any_case(df: DataFrame, column: str, schema: StructType, name: str) -> DataFrame:
    """Add the record of a JSON column whose names may be in snake case or in camel case.

    Each reading is a column of its own: an expression that uses a parsed value many
    times would parse it as often.
    """
    snake = F.from_json(col(column), schema)
    camel = F.from_json(col(column), camel_schema(schema)).cast(schema)
    both = df.withColumns({"_snake": snake, "_camel": camel})
    filled = fill(F.col("_snake"), F.col("_camel"), schema)
    return both.withColumn(name, filled).drop("_snake", "_camel")
