"""What all normalisers share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Optional, Union

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.nested import present
from feedloom.functions.times import now_ms
from feedloom.operators.sets import flatten_comments
from feedloom.schemas import struct

PAYLOAD = "payload"
Seen = Optional[Union[int, Column]]


def opened(
    df: DataFrame, ddl: str, where: Optional[Callable[[Column], Column]] = None
) -> DataFrame:
    """Payload fields as top-level columns, of the records that pass ``where``.

    A JSON text column ``payload`` is parsed with the declared schema; context
    columns (``source_keyword``, ``requested_id``, ...) stay. A frame that already
    has the fields gets the missing ones as NULL.
    """
    schema = struct(ddl)
    if PAYLOAD in df.columns:
        fields = {f.name for f in schema.fields}
        context = [c for c in df.columns if c != PAYLOAD and c not in fields]
        parsed = df.select(*context, F.from_json(F.col(PAYLOAD), schema).alias("_parsed"))
        if where is None:
            return parsed.select(*context, "_parsed.*")
        kept = F.when(where(F.col("_parsed")), F.col("_parsed"))
        return parsed.select(*context, F.inline(present(kept)))
    for field in schema.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df if where is None else df.where(where(F.struct(*schema.names)))


def context(df: DataFrame, name: str) -> Column:
    """A context column, NULL text when the frame has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def seen(as_of: Seen) -> Column:
    return now_ms(as_of).alias("last_modify_ts")


def text(c: Union[str, Column], default: Optional[str] = None) -> Column:
    out = (F.col(c) if isinstance(c, str) else c).cast("string")
    return out if default is None else F.coalesce(out, F.lit(default))


#: Ends of the names of columns that a platform table has no room for.
ITEMS, CODE = "_items", "_code"


def extra(wanted: bool, items: Optional[dict[str, Column]] = None, code: Optional[Column] = None) -> list[Column]:
    """What a normaliser adds with ``extras``: the arrays behind joined texts, without
    empty elements, as ``<column>_items``, and a gender as the platform codes it."""
    if not wanted:
        return []
    filled = {
        name: F.coalesce(
            F.filter(arr.cast("array<string>"), lambda x: F.length(x) > 0), F.array().cast("array<string>")
        )
        for name, arr in (items or {}).items()
    }
    out = [arr.alias(name + ITEMS) for name, arr in filled.items()]
    return out if code is None else [*out, code.cast("string").alias("gender" + CODE)]


def with_replies(df: DataFrame, ddl: str, child_field: str, id_col: str) -> DataFrame:
    """Level-1 comments and the replies they carry, as payload fields of one list, each with
    its ``level`` and ``top_id``, the id of its level-1 comment."""
    df = opened(df, ddl).withColumn("top_id", F.col(id_col))
    fields = {f.name for f in struct(ddl).fields}
    return flatten_comments(df, child_field, [c for c in df.columns if c not in fields])


def reply_to(named: Column) -> Column:
    """The comment that a row of ``with_replies`` answers: the one it names, else, as a
    reply, its level-1 comment."""
    return F.coalesce(F.nullif(named, F.lit("")), F.when(F.col("level") > 1, F.col("top_id")))
