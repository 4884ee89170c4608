"""Media manifest: which assets a content has and where each would be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.nested import ColumnOrName, col


def _usable(urls: Column) -> Column:
    return F.filter(urls, lambda u: F.length(u) > 0)


def xhs_manifest(df: DataFrame, content_id: str, images: ColumnOrName, videos: ColumnOrName) -> DataFrame:
    """``<id>/<n>.jpg`` and ``<id>/<n>.mp4``; the two lists are counted apart."""

    def assets(urls: ColumnOrName, extension: str) -> Column:
        listed = F.transform(
            _usable(col(urls)),
            lambda u, i: F.struct(
                i.cast("bigint").alias("ordinal"),
                u.alias("asset_url"),
                F.concat(i.cast("string"), F.lit(f".{extension}")).alias("file"),
            ),
        )
        return F.coalesce(
            listed, F.array().cast("array<struct<ordinal:bigint,asset_url:string,file:string>>")
        )

    both = F.concat(assets(images, "jpg"), assets(videos, "mp4"))
    rows = df.select(
        F.col(content_id).cast("string").alias("content_id"), F.explode(both).alias("_asset")
    )
    return rows.select(
        "content_id",
        "_asset.ordinal",
        "_asset.asset_url",
        F.concat("content_id", F.lit("/"), "_asset.file").alias("target_path"),
    )


def dy_manifest(df: DataFrame, content_id: str, images: ColumnOrName, video: ColumnOrName) -> DataFrame:
    """``<id>/<nnn>.jpeg`` for posts with images, else ``<id>/video.mp4``. Never both."""
    has_images = F.size(F.coalesce(col(images), F.array().cast("array<string>"))) > 0
    urls = F.when(has_images, col(images)).otherwise(F.array(col(video)))
    tagged = df.select(content_id, urls.alias("_urls"), has_images.alias("_images"))
    rows = tagged.select(
        F.col(content_id).cast("string").alias("content_id"),
        "_images",
        F.posexplode(_usable(F.col("_urls"))).alias("ordinal", "asset_url"),
    )
    name = F.when(F.col("_images"), F.format_string("%03d.jpeg", "ordinal")).otherwise("video.mp4")
    return rows.select(
        "content_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        "asset_url",
        F.concat("content_id", F.lit("/"), name).alias("target_path"),
    )


def bili_manifest(df: DataFrame, content_id: str, video: ColumnOrName) -> DataFrame:
    """``<id>/video.mp4`` for contents with a video URL."""
    return df.where(F.length(col(video)) > 0).select(
        F.col(content_id).cast("string").alias("content_id"),
        F.lit(0).cast("bigint").alias("ordinal"),
        col(video).alias("asset_url"),
        F.concat(F.col(content_id).cast("string"), F.lit("/video.mp4")).alias("target_path"),
    )


def wb_manifest(df: DataFrame, content_id: str, pics: ColumnOrName) -> DataFrame:
    """``<pid>.<extension of the url>`` for every picture with a URL."""
    usable = F.filter(col(pics), lambda p: F.length(p["url"]) > 0)
    rows = df.select(
        F.col(content_id).cast("string").alias("content_id"),
        F.posexplode(usable).alias("ordinal", "_pic"),
    )
    return rows.select(
        "content_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.col("_pic.url").alias("asset_url"),
        F.concat(
            F.col("_pic.pid"), F.lit("."), F.substring_index("_pic.url", ".", -1)
        ).alias("target_path"),
    )
