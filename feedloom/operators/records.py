"""Records whose shape drifts: typed fields out of JSON texts, and a quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Optional, Union

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

PROBLEMS = "problems"
STATE, VALID, REJECTED = "record_state", "valid", "rejected"


@dataclass(frozen=True)
class Field:
    """A field of a record: its Spark type, where it may stand, and whether it must be there.

    The first of ``paths`` that holds a value counts; a missing or unusable optional field
    becomes ``default``. A required text must not be blank.
    """

    kind: str
    paths: Union[str, Sequence[str]]
    required: bool = False
    default: object = None

    def places(self) -> list[str]:
        return [self.paths] if isinstance(self.paths, str) else list(self.paths)


def _field(record: Column, name: str, spec: Field) -> tuple[Column, Column]:
    """The value and what is wrong with it (NULL: nothing)."""
    found = [F.try_variant_get(record, path, "variant") for path in spec.places()]
    there = [F.when(~F.is_variant_null(v), v) for v in found]
    raw = F.coalesce(*there) if len(there) > 1 else there[0]
    value = F.try_variant_get(raw, "$", spec.kind)
    problem = F.when(raw.isNotNull() & value.isNull(), F.lit(f"type:{name}"))
    if spec.required:
        gone = raw.isNull()
        if spec.kind.lower() == "string":
            gone = gone | (F.length(F.trim(value)) == 0)
        problem = F.when(gone, F.lit(f"missing:{name}")).otherwise(problem)
    elif spec.default is not None:
        value = F.coalesce(value, F.lit(spec.default).cast(spec.kind))
    return value, problem


def check_records(df: DataFrame, fields: Mapping[str, Field], payload: str = "payload") -> DataFrame:
    """The rows with the record's fields as columns and ``problems``, what is wrong with it.

    The JSON text is read once, into a VARIANT, so fields may be missing, come in other
    types, or stand elsewhere in some records; a number in a text counts as one. Problems are
    ``empty`` (no text), ``not json``, ``missing:<field>`` of a required field and ``type:<field>``
    of a value that cannot be read as its type. An empty list means the record is valid: all
    required fields are there and each value has its type.
    """
    record = F.try_parse_json(F.col(payload))
    keep = [c for c in df.columns if c not in (*fields, PROBLEMS)]
    parsed = df.select(*keep, *([] if payload in keep else [payload]), record.alias("_record"))
    values, problems = {}, []
    for name, spec in fields.items():
        values[name], problem = _field(F.col("_record"), name, spec)
        problems.append(problem)
    whole = F.when(F.length(F.trim(F.coalesce(F.col(payload), F.lit("")))) == 0, F.array(F.lit("empty")))
    whole = whole.when(F.col("_record").isNull(), F.array(F.lit("not json")))
    listed = whole.otherwise(F.array_compact(F.array(*problems)))
    return parsed.select(*keep, *[v.alias(n) for n, v in values.items()], listed.alias(PROBLEMS))


def check_columns(df: DataFrame, required: Sequence[str], kinds: Optional[StructType] = None) -> DataFrame:
    """The rows of a normaliser with ``problems``: required columns that are NULL or blank and,
    with ``kinds``, columns whose text cannot be cast to their type there."""
    problems = [
        F.when(F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) == 0, F.lit(f"missing:{c}"))
        for c in required
    ]
    for f in kinds or ():
        if f.name in df.columns:
            bad = F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
            problems.append(F.when(bad, F.lit(f"type:{f.name}")))
    return df.withColumn(PROBLEMS, F.array_compact(F.array(*problems)))


def land_checked(checked: DataFrame, path: str, mode: str = "append") -> None:
    """Write checked rows in one pass: the valid ones and the quarantine lie apart in one
    folder, so the input is read once for both."""
    state = F.when(F.size(PROBLEMS) == 0, VALID).otherwise(REJECTED)
    checked.withColumn(STATE, state).write.mode(mode).partitionBy(STATE).parquet(path)


def read_valid(spark: SparkSession, path: str, schema: Optional[StructType] = None) -> DataFrame:
    """The valid rows, without ``problems``; only their folder is read. ``schema`` is that of
    the checked rows, needed where none were written."""
    return _landed(spark, path, schema).where(F.col(STATE) == VALID).drop(STATE, PROBLEMS)


def read_quarantine(
    spark: SparkSession, path: str, raw: Sequence[str] = ("payload",), schema: Optional[StructType] = None
) -> DataFrame:
    """The rejected records as they came, the columns ``raw``, with what is wrong with each."""
    return _landed(spark, path, schema).where(F.col(STATE) == REJECTED).select(*raw, PROBLEMS)


def _landed(spark: SparkSession, path: str, schema: Optional[StructType]) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields]).add(STATE, "string"))
    return reader.parquet(path)


# Fields without which a tieba record is none.
TIEBA_REQUIRED = {
    "note": ("note_id", "title", "note_url", "tieba_name", "tieba_link"),
    "comment": ("comment_id", "content", "note_id", "note_url", "tieba_id", "tieba_name", "tieba_link"),
    "creator": ("user_id", "user_name", "nickname", "avatar"),
}
