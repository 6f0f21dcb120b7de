"""Token ids in ORC files (operator 10).

Documents are range-sorted by id, encoded, and written as ORC: integer run-length encoding of the id lists, a row index
every `index_stride` rows and Bloom filters on doc_id, so readers take stripes in parallel and skip stripes and row
groups by their metadata. Each row carries its file part and place, so that running offsets need no global sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import read, slices, work_dir
from barloom.llm.tokens import default_path, encoder

END_ID = 2


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
    stripe_bytes: int = 16 << 20, index_stride: int = 1000, false_positives: float = 0.01,
) -> None:
    """Write (doc_id, part, place, ids) as ORC below `path`, in ascending doc_id order over parts and places.

    ids: the whole text's ids and end_id (null and empty texts: end_id alone). A null doc_id sorts first; rows with the
    same doc_id stay next to each other in any order; further columns of `docs` are not read; no rows give empty files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, encode = TaskContext.get().partitionId(), 0, encoder(vocabulary).encode
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                ids, at = encode(piece.column("text"))
                n = piece.num_rows
                ids = np.insert(ids, at[1:], end_id).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at + np.arange(n + 1), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(place, place + n)), lists],
                    ["doc_id", "part", "place", "ids"])
                place += n

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(run, "doc_id long, part long, place long, ids array<int>").write.options(**{
        "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_stride, "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": false_positives, "compression": "zstd",
    }).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, place, ids); a filter on doc_id skips stripes and row groups by statistics and Bloom filters."""
    return spark.read.schema("doc_id long, part long, place long, ids array<int>").orc(path)


def token_index(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of token files. start: ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "part", "place")), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    counted = rows.mapInArrow(run, "doc_id long, part long, place long, n_tokens long, ids_crc32 long")
    # a part is a bounded file; the table of parts has one row per file
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    parts = counted.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = counted.withColumn("inside", inside).join(before, "part")
    return out.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as ORC, read the files back and return each document's place in them."""
    path = work_dir(spark, "tokens")
    write_token_files(read(spark, sf_dir, "documents", "doc_id", "text"), path, default_path("byte_bpe_50k.json"))
    return token_index(read_token_files(spark, path))
