"""Keyed upserts that rewrite only the hash buckets they touch.

A table folder holds ``data/v=<n>/_bucket=<b>`` with the files that commit n wrote, and
``manifest/<n>.json``, which names the live files of every bucket after commit n. A commit
counts once its manifest is there; manifests are put in place by a rename that fails where
one exists, so of two writers of the same number one has to look again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from feedloom.session import shared_path
from feedloom.sinks.upsert import ADDED, last_updates, upsert

BUCKET = "_bucket"
#: Commits that a writer whose buckets others keep changing tries before it gives up.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Manifest:
    """What a table is after commit ``version``: its keys and columns, the live files of
    each bucket that has any, and the last batch taken in of each named writer."""

    version: int
    buckets: int
    keys: tuple[str, ...]
    schema: Optional[str] = None
    live: dict[int, tuple[str, ...]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def load(text: str) -> "Manifest":
        got = json.loads(text)
        live = {int(b): tuple(files) for b, files in got.pop("live").items()}
        return Manifest(**{**got, "keys": tuple(got["keys"]), "live": live})

    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


class Folder:
    """Files of a table folder, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.hadoop)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        folder = self.at(name)
        return [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []

    def files(self, name: str) -> Iterator[str]:
        """Data files below a folder, by their path from the table's."""
        folder = self.at(name)
        if not self.fs.exists(folder):
            return
        root = self.fs.makeQualified(self.at("")).toString()
        found = self.fs.listFiles(folder, True)
        while found.hasNext():
            file = found.next().getPath()
            if file.getName().startswith("part-"):
                yield file.toString()[len(root) + 1 :]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """The file, whole or not at all; ``Conflict`` if there is one."""
        part = self.at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self.fs.getUri(), self.hadoop)
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(part, self.at(name), options)
        except Exception as e:
            self.fs.delete(part, False)
            if self.fs.exists(self.at(name)):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    names = Folder(spark, path).names("manifest")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: Optional[int] = None) -> Optional[Manifest]:
    """The manifest of a version, by default the newest; None where there is none."""
    found = manifests(spark, path)
    if version is None and found:
        version = found[-1]
    return Manifest.load(Folder(spark, path).read(f"manifest/{version:010d}.json")) if version in found else None


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)


def read_buckets(
    spark: SparkSession,
    path: str,
    version: Optional[int] = None,
    only: Optional[Sequence[int]] = None,
) -> Optional[DataFrame]:
    """The table after a commit, by default the newest; ``only`` some of its buckets.

    None where nothing was committed. Columns that a file lacks are NULL in its rows.
    """
    found = manifest(spark, path, version)
    return None if found is None or found.schema is None else _rows(spark, path, found, only)


def _rows(spark: SparkSession, path: str, of: Manifest, only: Optional[Sequence[int]] = None) -> DataFrame:
    wanted = of.live if only is None else {b: of.live[b] for b in only if b in of.live}
    files = [f"{path.rstrip('/')}/{f}" for own in wanted.values() for f in own]
    schema = of.struct()
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def upsert_buckets(
    updates: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str],
    seen: str = "last_modify_ts",
    buckets: int = 256,
    writer: Optional[str] = None,
    batch: Optional[int] = None,
) -> Optional[int]:
    """Upsert into a bucketed table folder; the version committed.

    The table becomes what ``upsert`` makes of it: what is committed last wins, ``add_ts``
    stays, a column that the updates lack keeps its value, NULL keys are keys. Updates are
    reduced to a row a key and written once; of the table, only buckets that have a key of
    theirs are read and written. No updates: no commit, None.

    ``buckets`` counts for a new table; an old one keeps its number. ``writer`` and ``batch``
    make a repeated batch of a writer harmless: one that is not after its last is not taken
    in again (None). Writers may overlap: if another has committed meanwhile, one that
    touched none of the same buckets only commits anew, any other merges anew.
    """
    spark = updates.sparkSession
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    folder = Folder(spark, path)
    base = manifest(spark, path) or Manifest(-1, buckets, tuple(keys))
    if base.keys != tuple(keys):
        raise ValueError(f"the table has the keys {list(base.keys)}")
    if writer is not None and batch is not None and base.batches.get(writer, -1) >= batch:
        return None
    new = last_updates(updates, keys, order, seen).withColumn(BUCKET, bucket_of(keys, base.buckets))
    staged = shared_path(spark, "updates")
    new.write.parquet(staged)
    try:
        new = spark.read.schema(new.schema).parquet(staged)
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most all buckets
        if not touched:
            return None
        written = None
        for _ in range(ATTEMPTS):
            if written is None:
                written = _merge(spark, path, base, new, touched, keys, order)
            name, schema, files = written
            after = replace(
                base,
                version=base.version + 1,
                schema=schema.json(),
                live={b: f for b, f in {**base.live, **files}.items() if f},
                batches={**base.batches, **({writer: batch} if writer is not None and batch is not None else {})},
            )
            try:
                folder.create(f"manifest/{after.version:010d}.json", after.dump())
                return after.version
            except Conflict:
                now = manifest(spark, path)
                if writer is not None and batch is not None and now.batches.get(writer, -1) >= batch:
                    folder.delete(name)
                    return None
                same = all(now.live.get(b) == base.live.get(b) for b in touched) and now.schema == base.schema
                base = now
                if not same:
                    folder.delete(name)
                    written = None
        raise Conflict(f"{path}: {ATTEMPTS} commits of others came first")
    finally:
        Folder(spark, staged).delete("")


def _merge(
    spark: SparkSession, path: str, base: Manifest, new: DataFrame, touched: list[int], keys: list[str], order: list[str]
) -> tuple[str, StructType, dict[int, tuple[str, ...]]]:
    """Write the touched buckets after the updates: their folder, columns and files."""
    fresh = new.drop(BUCKET)
    if base.schema is None:
        merged = fresh.withColumnRenamed("_first_seen", ADDED)
    else:
        merged = upsert(_rows(spark, path, base, touched), fresh, keys, order, "_first_seen", reduced=True)
    name = f"data/v={base.version + 1:010d}-{uuid.uuid4().hex[:8]}"
    rows = merged.withColumn(BUCKET, bucket_of(keys, base.buckets))
    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path.rstrip('/')}/{name}")
    files: dict[int, list[str]] = {b: [] for b in touched}
    for file in Folder(spark, path).files(name):
        files[int(file.split(f"/{BUCKET}=")[1].split("/")[0])].append(file)
    return name, merged.schema, {b: tuple(sorted(f)) for b, f in files.items()}


def drop_dead_files(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` manifests and every data file that those left do
    not name; how many files went. Run it while no writer is at work: files of a commit that
    is not there yet are named by none."""
    folder = Folder(spark, path)
    found = manifests(spark, path)
    kept = found[-max(keep, 1) :]
    live = {f for v in kept for own in manifest(spark, path, v).live.values() for f in own}
    for v in found[: -max(keep, 1)]:
        folder.delete(f"manifest/{v:010d}.json")
    dead = [f for f in folder.files("data") if f not in live]
    for file in dead:
        folder.delete(file)
    for commit in folder.names("data"):
        if next(folder.files(f"data/{commit}"), None) is None:
            folder.delete(f"data/{commit}")
    return len(dead)
