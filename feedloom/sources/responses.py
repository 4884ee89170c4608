"""Landed raw responses and their envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom.functions.codes import PLATFORMS
from feedloom.functions.nested import present

_BAD = "_corrupt"
# A field declared as STRING keeps nested JSON as text, so one parse checks the
# whole record and yields flag, message and payload.
_ENVELOPE = (
    "success BOOLEAN, code BIGINT, ok INT, data STRING, errors STRING, error STRING, "
    f"msg STRING, message STRING, {_BAD} STRING"
)


def read_responses(
    spark: SparkSession, path: str, platform: str, kind: str, per_file: bool = False
) -> DataFrame:
    """``platform, kind, path, fetched_at, body``: one response per line, or per file."""
    if platform not in PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}")
    lines = spark.read.text(path, wholetext=per_file)
    return lines.select(
        F.lit(platform).alias("platform"),
        F.lit(kind).alias("kind"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.col("value").alias("body"),
    )


def _rules(platform: str, e: Column, body: Column) -> tuple[Column, Column, Column]:
    """(is a success, payload, error text) of one platform's envelope."""
    sound = body.isNotNull() & e[_BAD].isNull()
    if platform == "xhs":
        return sound & e["success"], F.coalesce(e["data"], F.lit("{}")), e["msg"]
    if platform == "bili":
        return sound & (e["code"] == 0), F.coalesce(e["data"], F.lit("{}")), e["message"]
    if platform == "ks":
        clean = F.coalesce(e["errors"], F.lit("[]")).isin("[]", "null", "")
        return sound & clean, F.coalesce(e["data"], F.lit("{}")), e["errors"]
    if platform == "wb":
        return sound & (e["ok"] == 1), F.coalesce(e["data"], F.lit("{}")), e["msg"]
    if platform == "zhihu":
        reason = F.coalesce(F.get_json_object(e["error"], "$.message"), e["error"])
        return sound & e["error"].isNull(), body, reason
    if platform in ("dy", "tieba"):
        return ~F.trim(body, F.lit(" \t\r\n")).isin("", "blocked"), body, body
    raise ValueError(f"unknown platform {platform!r}")


def open_envelope(df: DataFrame, platform: str, body: str = "body") -> DataFrame:
    """``payload`` of a success or ``error`` of a failure beside each response.

    Exactly one of the two is filled. One pass: write the result partitioned by
    ``error IS NULL`` to land both kinds without a second scan.
    """
    envelope = F.from_json(F.col(body), _ENVELOPE, {"columnNameOfCorruptRecord": _BAD})
    parsed = df.withColumn("_e", envelope)
    success, payload, reason = _rules(platform, F.col("_e"), F.col(body))
    success = F.coalesce(success, F.lit(False))
    return parsed.withColumns(
        {
            "payload": F.when(success, payload),
            "error": F.when(~success, F.coalesce(reason, F.lit("unreadable response"))),
        }
    ).drop("_e")


def unwrap_envelope(
    df: DataFrame, platform: str, body: str = "body"
) -> tuple[DataFrame, DataFrame]:
    """Successful responses with their ``payload``, and failed ones with an ``error``.

    The two frames are disjoint and together are the input. Unparsable bodies fail.
    """
    opened = open_envelope(df, platform, body)
    ok = [c for c in df.columns if c != body]
    return (
        opened.select(*ok, F.explode(present("payload")).alias("payload")),
        opened.select(*df.columns, F.explode(present("error")).alias("error")),
    )


def explode_payload(df: DataFrame, field: str) -> DataFrame:
    """One row per element of the list ``field`` of a payload, elements as JSON text."""
    parsed = F.from_json("payload", f"`{field}` ARRAY<STRING>")
    keep = [c for c in df.columns if c != "payload"]
    return df.select(*keep, F.posexplode(parsed[field]).alias("payload_pos", "payload"))
