"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator assumes. ANSI mode stays as it is."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="feedloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/feedloom/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The frame as a table at ``path``, read again: a cut of the lineage that any executor
    can lose and whose size Catalyst knows (a checkpoint keeps the estimate of its plan,
    which grows beyond all bounds where it is joined round by round)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (no job is run)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


SPREAD_BELOW = 512 << 20


def broadcast_limit(spark: SparkSession) -> int:
    """Largest estimated side Catalyst broadcasts, in bytes (-1: none)."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def is_small(df: DataFrame) -> bool:
    """Whether Catalyst will broadcast the frame."""
    return estimated_bytes(df) <= broadcast_limit(df.sparkSession)


def spread(df: DataFrame) -> DataFrame:
    """Split a small, badly split input before CPU-heavy work.

    A table of a few row groups would run on a few cores however many there are.
    Only inputs below SPREAD_BELOW bytes are shuffled; larger ones have splits enough,
    and a stream's micro-batches are split by its source.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if cores > 1 and estimated_bytes(df) < SPREAD_BELOW:
        return df.repartition(cores)
    return df
