"""Sinks (SK operators): replace, run-date overwrite, upsert, export."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.ranking import first_per_key


def write_replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_run_date(df: DataFrame, path: str, partition: str = "date") -> None:
    """Replace only the run dates present in `df`; running it twice changes nothing.

    The rebalance hint gathers small dates into few files and splits a large one over tasks.
    """
    (
        df.hint("rebalance", partition).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT OR REPLACE: an incoming row replaces the stored row with the same key."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return first_per_key(both, keys, [F.col("_new").desc()]).drop("_new")


def has_partitions(spark: SparkSession, path: str, partition: str) -> bool:
    """Whether a dataset partitioned by `partition` is stored there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{partition}=*")
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place))


def is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def upsert_path(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str],
                partition: str = "date", order: Sequence[Column] = ()) -> None:
    """Upsert into a dataset partitioned by `partition`, which must be one of the keys.

    An incoming row replaces the stored one with its key; with `order`, the first of both in that order stays, whenever
    it came. Both sides must have the same columns. Only the partitions of the incoming rows are read. They are
    materialised to a folder of this call's own first, because a dataset cannot be overwritten while it is read.
    """
    stored = spark.read.parquet(path)
    if set(stored.columns) != set(incoming.columns):
        raise ValueError(f"columns differ: {sorted(set(stored.columns) ^ set(incoming.columns))}")
    touched = stored.join(incoming.select(partition).distinct(), partition, "left_semi").select(*incoming.columns)
    merged = first_per_key(touched.unionByName(incoming), keys, order) if order else upsert(touched, incoming, keys)
    side = f"{path.rstrip('/')}__merge-{uuid.uuid4().hex}"
    write_replace(merged, side)
    write_run_date(spark.read.parquet(side), path, partition)
    _remove(spark, side)  # after a failed overwrite it holds the only complete copy


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
