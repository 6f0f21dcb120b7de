"""Tables with commits: data folders that never change, and one small manifest per version.

A write puts its rows into a new folder, one sub-folder per partition value, and then names them in the manifest of the next
version, which appears by a single rename that fails if the version exists. Until then readers see the version before, and a
write that dies leaves folders no manifest names. A reader holds the folders of one version, so later commits don't reach it.
Two writers from one version: the second to commit is rebased if they touched different partitions, else it fails and removes
its folder. A manifest has an entry per partition value; rows never pass the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.ranking import first_per_key
from barloom.sources.sinks import upsert

_WHOLE = ""  # the only partition of a table without partitions


class VersionConflict(RuntimeError):
    """Another writer committed to the same partitions."""


class Version(NamedTuple):
    number: int
    schema: str  # as JSON
    partition: str | None
    folders: dict[str, str]  # partition value as text -> folder


class _Files:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.none = spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        self.fs = self.hadoop.Path(path).getFileSystem(self.conf)

    def names(self, path: str) -> list[str]:
        place = self.hadoop.Path(path)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def text(self, path: str) -> str:
        stream = self.fs.open(self.hadoop.Path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that appears whole; False if it exists."""
        side = self.hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(side, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(side), self.fs.makeQualified(self.hadoop.Path(path)), self.none)
            return True
        except Exception as e:
            self.fs.delete(side, False)
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False

    def remove(self, path: str) -> None:
        self.fs.delete(self.hadoop.Path(path), True)


def _manifest(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/versions/{number:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions kept, oldest first."""
    return [int(n[:12]) for n in _Files(spark, path).names(f"{path.rstrip('/')}/versions") if n.endswith(".json")]


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """A version by number, the newest by default; None for a table not written yet."""
    if number is None:
        known = versions(spark, path)
        if not known:
            return None
        number = known[-1]
    return Version(**json.loads(_Files(spark, path).text(_manifest(path, number))))


def read_version(spark: SparkSession, path: str, number: int | None = None, wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """The rows of a version; `wanted` picks partitions by their value as text, others are not listed or read."""
    found = version(spark, path, number)
    if found is None:
        raise FileNotFoundError(f"no version of {path}")
    return _rows(spark, found, wanted)


def _rows(spark: SparkSession, found: Version, wanted: Callable[[str], bool] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(found.schema))
    folders = [f for value, f in sorted(found.folders.items()) if wanted is None or wanted(value)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _written(df: DataFrame, path: str, partition: str | None) -> tuple[str, dict[str, str]]:
    """(new data folder, its folder by partition value)."""
    folder = f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    if partition is None:
        df.write.parquet(folder)
        return folder, {_WHOLE: folder}
    # the column itself stays in the files; small partitions get few files, a large one is spread
    df.withColumn("_part", F.col(partition).cast("string")).hint("rebalance", partition).write.partitionBy("_part").parquet(folder)
    names = [n for n in _Files(df.sparkSession, path).names(folder) if n.startswith("_part=")]
    return folder, {n.removeprefix("_part="): f"{folder}/{n}" for n in names}


def _commit(df: DataFrame, path: str, partition: str | None, base: Version | None, replace: bool, retries: int = 20) -> int:
    spark = df.sparkSession
    files = _Files(spark, path)
    schema = df.schema.json()
    folder, made = _written(df, path, partition)
    try:
        for _ in range(retries):
            now = version(spark, path)
            seen, held = (v.folders if v else {} for v in (base, now))
            if replace and (now.number if now else None) != (base.number if base else None):
                raise VersionConflict(f"{path} changed while it was replaced")
            if any(seen.get(p) != held.get(p) for p in made):
                raise VersionConflict(f"{path}: another writer changed the same partitions")
            if now and not replace and (now.partition != partition or _names(now.schema) != _names(schema)):
                raise ValueError(f"{path} has other columns or partitions")
            number = now.number + 1 if now else 1
            new = Version(number, schema if replace or not now else now.schema, partition, made if replace else held | made)
            if files.create(_manifest(path, number), json.dumps(new._asdict())):
                return number
        raise VersionConflict(f"{path}: no commit in {retries} tries")
    except BaseException:
        files.remove(folder)
        raise


def _names(schema: str) -> list[tuple[str, str]]:
    return sorted((f["name"], json.dumps(f["type"])) for f in json.loads(schema)["fields"])


def commit_replace(df: DataFrame, path: str, partition: str | None = None, base: Version | None = None) -> int:
    """A version that holds exactly the rows of `df`; its number. Fails if another version came after `base` (by default the one
    now). `df` may read any version of the table."""
    return _commit(df, path, partition, base or version(df.sparkSession, path), True)


def commit_run_date(df: DataFrame, path: str, partition: str = "date", base: Version | None = None) -> int:
    """A version in which the partitions of `df` hold its rows; running it twice changes nothing."""
    return _commit(df, path, partition, base or version(df.sparkSession, path), False)


def commit_upsert(df: DataFrame, path: str, keys: Sequence[str], partition: str = "date", order: Sequence[Column] = (), base: Version | None = None) -> int:
    """A version in which the rows of `df` replace those with their keys (with `order`: the first of both stays); the partition is
    one of the keys. Only partitions with new rows are read and written."""
    if partition not in keys:
        raise ValueError("the partition must be one of the keys")
    spark = df.sparkSession
    base = base or version(spark, path)
    if base is None:
        return _commit(first_per_key(df, keys, list(order) or [F.lit(0)]), path, partition, None, False)
    touched = {str(r[0]) for r in df.select(F.col(partition).cast("string")).distinct().collect()}  # partition values only
    stored = _rows(spark, base, lambda value: value in touched).select(*df.columns)
    merged = first_per_key(stored.unionByName(df), keys, list(order)) if order else upsert(stored, df, keys)
    return _commit(merged, path, partition, base, False)


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Drop all but the newest `keep` versions and the folders only they name. Folders of writes under way are kept: only what an
    expired manifest names goes."""
    files, known = _Files(spark, path), versions(spark, path)
    old, rest = known[:-keep], known[-keep:]
    held = {f for n in rest for f in version(spark, path, n).folders.values()}
    for n in old:
        for folder in set(version(spark, path, n).folders.values()) - held:
            files.remove(folder)
        files.remove(_manifest(path, n))
