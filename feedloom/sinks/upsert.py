"""Keyed upserts: one row per natural key, first ``add_ts`` kept."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any, Optional

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType

from feedloom.session import is_small

ADDED = "add_ts"
VERSION = "v="


def _orderable(kind: DataType) -> bool:
    return not any(t in kind.simpleString() for t in ("map<", "variant"))


def last_updates(updates: DataFrame, keys: Sequence[str], order: Sequence[str], seen: str) -> DataFrame:
    """One row per key: the payload of its last update, and when it was first seen.

    Updates equal in ``order`` are settled by their payload, so the result does not
    depend on partitioning. A partial aggregate per mapper: a key with very many
    updates reaches its task as one row per mapper.
    """
    payload = [c for c in updates.columns if c not in keys and c != ADDED]
    rest = [c for c in payload if c not in order and _orderable(updates.schema[c].dataType)]
    position = F.struct(*order, *rest)
    if set(payload) <= {*order, *rest}:
        last = F.max(position)
    else:
        last = F.max_by(F.struct(*payload), position)
    grouped = updates.groupBy(*keys).agg(last.alias("_last"), F.min(seen).alias("_first_seen"))
    return grouped.select(*keys, *[F.col("_last")[c].alias(c) for c in payload], "_first_seen")


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    seen: str = "last_modify_ts",
    reduced: bool = False,
) -> DataFrame:
    """Target after the updates.

    ``order`` names ascending columns, a total order of the updates of a key: the last
    one wins. All its payload columns replace the target's, NULLs too. ``add_ts`` is
    kept, or set to the time of a new key's first update. Columns that only the target
    has are kept as they are. NULL keys are keys like others. The size of the updates is
    checked: small ones are broadcast to the target, others are matched by a full outer join.
    ``reduced`` updates come from ``last_updates``.
    """
    keys = list(keys)
    new = updates if reduced else last_updates(updates, keys, order, seen)
    if is_small(new):
        return _merge_small(target, new, keys)
    return _merge_full(target, new, keys)


def _key(keys: Sequence[str]) -> Column:
    """The key as one value: inside a struct NULL equals NULL."""
    return F.struct(*keys).alias("_k")


def _merge_full(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of the target with one update per key."""
    rest, fresh = _columns(target, new, keys)
    old = target.select(_key(keys), F.struct(*rest, ADDED).alias("_t"))
    put = new.select(_key(keys), F.struct(*[c for c in new.columns if c not in keys]).alias("_u"))
    t, u = F.col("_t"), F.col("_u")

    def value(name: str) -> Column:
        if name not in new.columns:
            return t[name]
        if name not in rest:
            return u[name]
        return F.when(u.isNotNull(), u[name]).otherwise(t[name])

    return old.join(put, "_k", "full_outer").select(
        *[F.col("_k")[k].alias(k) for k in keys],
        *[value(c).alias(c) for c in [*rest, *fresh]],
        F.coalesce(t[ADDED], u["_first_seen"]).alias(ADDED),
    )


def _merge_small(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Untouched target rows, and the updates with what they take over from the target.

    The updates are broadcast to the target, which is not shuffled at all.
    """
    rest, fresh = _columns(target, new, keys)
    only_old = [c for c in rest if c not in new.columns]
    wanted = new.select(_key(keys))
    untouched = target.withColumn("_k", _key(keys)).join(wanted, "_k", "left_anti").drop("_k")
    taken = target.select(_key(keys), *only_old, ADDED).join(wanted, "_k", "left_semi")
    put = new.withColumn("_k", _key(keys)).join(taken, "_k", "left").drop("_k")
    put = put.withColumn(ADDED, F.coalesce(ADDED, "_first_seen"))
    columns = [*keys, *rest, *fresh, ADDED]
    return untouched.unionByName(put.drop("_first_seen"), allowMissingColumns=True).select(*columns)


def _columns(target: DataFrame, new: DataFrame, keys: list[str]) -> tuple[list[str], list[str]]:
    """Payload columns of the target, and those only the updates have."""
    rest = [c for c in target.columns if c not in keys and c != ADDED]
    return rest, [c for c in new.columns if c not in keys and c not in rest and c != "_first_seen"]


def keep_all_keywords(df: DataFrame, keys: Sequence[str], keyword: str = "source_keyword") -> list[str]:
    """Keys that keep one row per keyword, for stores that want every keyword's hit."""
    return [*keys, keyword] if keyword in df.columns else list(keys)


def update_where(df: DataFrame, sets: Mapping[str, Any], key: str, value: Any) -> DataFrame:
    """Set columns where ``key`` equals ``value``."""
    hit = F.col(key).eqNullSafe(F.lit(value))
    changed = {
        c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c))
        for c, v in sets.items()
    }
    return df.withColumns(changed)


def affected(df: DataFrame, key: str, value: Any) -> DataFrame:
    """One row, ``affected``: how many rows such an update changes."""
    return df.where(F.col(key).eqNullSafe(F.lit(value))).agg(F.count(F.lit(1)).alias("affected"))


# --- versioned folders ----------------------------------------------------
#
# Plain Parquet has no MERGE. A version is written beside the one it was read from,
# and counts once its _SUCCESS file is there, so a failed write changes nothing.


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table folder, oldest first (one folder listing)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(VERSION) and fs.exists(done):
            found.append(int(name[len(VERSION):]))
    return sorted(found)


def current(spark: SparkSession, path: str) -> Optional[DataFrame]:
    done = versions(spark, path)
    return spark.read.parquet(f"{path}/{VERSION}{done[-1]:010d}") if done else None


def upsert_path(
    updates: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str],
    seen: str = "last_modify_ts",
    version: Optional[int] = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Upsert into the newest version of a table folder and write the next version.

    ``version`` makes the write repeatable: writing version N again replaces it and
    reads version N - 1 or older. Without it a version that another writer has begun
    meanwhile is an error, not overwritten; what a writer left that broke off is replaced
    by naming its version. ``drop_versions`` removes old ones.
    """
    spark = updates.sparkSession
    order = [order] if isinstance(order, str) else list(order)
    done = versions(spark, path)
    mode = "errorifexists" if version is None else "overwrite"
    version = (done[-1] + 1 if done else 0) if version is None else version
    older = [v for v in done if v < version]
    if older:
        target = spark.read.parquet(f"{path}/{VERSION}{older[-1]:010d}")
        merged = upsert(target, updates, keys, order, seen)
    else:
        merged = last_updates(updates, keys, order, seen).withColumnRenamed("_first_seen", ADDED)
    writer = merged.write.mode(mode)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.parquet(f"{path}/{VERSION}{version:010d}")


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the newest complete versions."""
    jvm = spark.sparkContext._jvm
    for version in versions(spark, path)[:-max(keep, 1)]:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{VERSION}{version:010d}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# --- merge on read --------------------------------------------------------
#
# A table folder holds arrival=<n>/run=<name>/batch=<n>: arrivals count up over all writers.

WRITTEN = "_written"
FIRST_RUN = "r000001"


def _arrivals(spark: SparkSession, path: str) -> dict[tuple[str, str], int]:
    """The arrival of each (run, batch) that the table has."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "arrival=*/run=*/batch=*")) or []:
        arrival, run, batch = status.getPath().toString().split("/")[-3:]
        found[run.removeprefix("run="), batch.removeprefix("batch=")] = int(arrival.removeprefix("arrival="))
    return found


def append_updates(
    updates: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str],
    batch: int,
    seen: str = "last_modify_ts",
    run: str = FIRST_RUN,
) -> None:
    """Upsert without touching the table: one row per key, in the batch's own folder.

    A batch arrives after all that are there, whatever their runs; writing a batch of a run
    again replaces it where it stands. ``read_upserts`` folds the folders.
    """
    spark = updates.sparkSession
    rows = last_updates(updates, keys, order, seen).withColumnRenamed("_first_seen", ADDED)
    payload = [c for c in rows.columns if c not in keys and c != ADDED]
    rows = rows.withColumn(WRITTEN, F.array(*map(F.lit, payload)).cast("array<string>"))
    there = _arrivals(spark, path)
    arrival = there.get((run, str(batch)), 1 + max(there.values(), default=0))
    rows.write.mode("overwrite").parquet(f"{path}/arrival={arrival:010d}/run={run}/batch={batch}")


def run_of(spark: SparkSession, path: str, checkpoint: str) -> str:
    """The run that a checkpoint stands for: the one it had, or the next."""
    runs = sorted({run for run, _ in _arrivals(spark, path)})
    mark = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    for run in runs:
        if run.endswith(f"-{mark}"):
            return run
    last = max((int(r[1:7]) for r in runs), default=int(FIRST_RUN[1:]))
    return f"r{last + 1:06d}-{mark}"


def read_upserts(
    spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """The table that the batches of updates stand for, as ``upsert`` would have made it.

    A key's row is that of its last batch, by arrival; a column that a batch did not have
    keeps its value; ``add_ts`` is that of the first batch. ``order`` settled updates
    within their batch already.
    """
    parts = spark.read.option("mergeSchema", "true").parquet(path)
    arrived = F.struct("arrival", "run", "batch")
    payload = [c for c in parts.columns if c not in (*keys, ADDED, WRITTEN, "arrival", "run", "batch")]
    # an update without the column has no place in the order of its values
    last = lambda c: F.max_by(c, F.when(F.array_contains(WRITTEN, c), arrived)).alias(c)
    return parts.groupBy(*keys).agg(*map(last, payload), F.min_by(ADDED, arrived).alias(ADDED))


def compact_upserts(
    spark: SparkSession, path: str, into: str, keys: Sequence[str], order: Sequence[str] = ()
) -> None:
    """Fold all batches into one at another path; read and append there from then on."""
    folded = read_upserts(spark, path, keys, order)
    payload = [c for c in folded.columns if c not in keys and c != ADDED]
    folded = folded.withColumn(WRITTEN, F.array(*map(F.lit, payload)).cast("array<string>"))
    folded.write.mode("overwrite").parquet(f"{into}/arrival={0:010d}/run=r000000/batch=-1")


def upsert_catalog(
    updates: DataFrame, table: str, keys: Sequence[str], order: Sequence[str], seen: str = "last_modify_ts"
) -> None:
    """The same on a table whose format supports row-level MERGE."""
    new = last_updates(updates, keys, order, seen).alias("u")
    payload = [c for c in updates.columns if c not in keys and c != ADDED]
    match = reduce(lambda a, b: a & b, [F.col(f"{table}.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys])
    sets = {c: F.col(f"u.{c}") for c in payload}
    (
        new.mergeInto(table, match)
        .whenMatched().update(sets)
        .whenNotMatched().insert(
            {**{k: F.col(f"u.{k}") for k in keys}, **sets, ADDED: F.col("u._first_seen")}
        )
        .merge()
    )
