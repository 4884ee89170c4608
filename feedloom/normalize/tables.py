"""The 22 platform tables: which normaliser fills each, and their schemas.

Schemas are those of the normalisers' output, taken from an empty input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from feedloom.normalize import bili, dy, ks, tieba, wb, xhs, zhihu
from feedloom.normalize.common import PAYLOAD
from feedloom.schemas import NATURAL_KEYS
from feedloom.sinks.files import append_table
from feedloom.sinks.upsert import ADDED, upsert_path


@dataclass(frozen=True)
class Filler:
    """A normaliser, its input column, and the context columns it expects."""

    normalize: Callable[[DataFrame], DataFrame]
    source: str = PAYLOAD
    context: tuple[str, ...] = ()


_CREATOR = ("creator_id", "creator_name", "creator_sign", "creator_avatar")

FILLERS = {
    "bilibili_video": Filler(bili.normalize_video, context=("source_keyword",)),
    "bilibili_video_comment": Filler(bili.normalize_comment, context=("requested_id",)),
    "bilibili_up_info": Filler(bili.normalize_creator),
    "bilibili_contact_info": Filler(bili.normalize_fans, context=_CREATOR),
    "bilibili_up_dynamic": Filler(bili.normalize_activity, context=_CREATOR[:2]),
    "douyin_aweme": Filler(dy.normalize_post, context=("source_keyword",)),
    "douyin_aweme_comment": Filler(dy.normalize_comment),
    "dy_creator": Filler(dy.normalize_creator, context=("user_id",)),
    "kuaishou_video": Filler(ks.normalize_video, context=("source_keyword",)),
    "kuaishou_video_comment": Filler(ks.normalize_comment, context=("requested_id",)),
    "weibo_note": Filler(wb.normalize_note, context=("source_keyword",)),
    "weibo_note_comment": Filler(wb.normalize_comment, context=("requested_id",)),
    "weibo_creator": Filler(wb.normalize_creator, context=("user_id",)),
    "xhs_creator": Filler(xhs.normalize_creator, context=("user_id",)),
    "xhs_note": Filler(xhs.normalize_note, context=("source_keyword",)),
    "xhs_note_comment": Filler(xhs.normalize_comment, context=("requested_id",)),
    "tieba_note": Filler(tieba.normalize_search, "html", ("source_keyword",)),
    "tieba_comment": Filler(tieba.normalize_comment, "html", ("note_id",)),
    "tieba_creator": Filler(tieba.normalize_creator, "html"),
    "zhihu_content": Filler(zhihu.normalize_content, context=("source_keyword",)),
    "zhihu_comment": Filler(zhihu.normalize_comment, context=("content_id", "content_type")),
    "zhihu_creator": Filler(zhihu.normalize_creator, "html", ("url_token",)),
}


def table_schema(spark: SparkSession, table: str) -> StructType:
    """Columns of a platform table, with ``add_ts`` at the end."""
    filler = FILLERS[table]
    columns = ", ".join(f"{c} STRING" for c in (filler.source, *filler.context))
    empty = spark.createDataFrame([], columns)
    return filler.normalize(empty).withColumn(ADDED, F.lit(0).cast("bigint")).schema


def init_platform_tables(spark: SparkSession, database: str) -> list[str]:
    """Drop and create the 22 platform tables of a database."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for table in FILLERS:
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in table_schema(spark, table).fields
        )
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{table}`")
        spark.sql(f"CREATE TABLE `{database}`.`{table}` ({columns}) USING parquet")
    return [f"{database}.{table}" for table in FILLERS]


def insert_rows(rows: DataFrame, database: str, table: str) -> None:
    """Append normalised rows to a platform table; new rows are added when last modified."""
    append_table(rows.withColumn(ADDED, F.col("last_modify_ts")), f"{database}.{table}")


def upsert_rows(rows: DataFrame, root: str, table: str, order: list[str] | None = None) -> None:
    """Upsert normalised rows into the folder of a platform table, by its natural key."""
    upsert_path(rows, f"{root}/{table}", NATURAL_KEYS[table], order or ["last_modify_ts"])
