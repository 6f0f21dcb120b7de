"""Shared helpers of the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barloom.session import work_dir

__all__ = ["buffers", "discard", "read", "stored", "work_dir", "slices"]


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").select(*columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the shared folder and read them back.

    Spark removes the shuffle files of a finished step only once the driver's garbage is collected, which a driver with
    little to do puts off; asking for it here keeps the disk needed to that of the steps at work.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stored_at = path
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def discard(*steps: DataFrame) -> None:
    """Delete stored steps that nothing still to be computed reads; frames that are not stored ones are passed over."""
    for df in steps:
        if path := getattr(df, "stored_at", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts on end, offsets of each text) of a string or binary array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) else b"")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the named text column holds about `most_bytes` a piece (one row at least)."""
    _, at = buffers(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(at, at[start] + most_bytes, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop
