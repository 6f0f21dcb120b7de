"""Bulk-synchronous best-fit packing (operator 6).

Pieces of equal length are interchangeable, and so are open sequences with equal gaps. Documents are range-sorted by
length and get a rank in their length; from then on a round handles runs: `count` pieces of one length with consecutive
ranks, and `count` sequences with one gap and consecutive numbers. A round sweeps both sorted lists for the successor of
every run of pieces (the smallest gap it fits), settles conflicts by rank (the longest pieces first, the first ranks of a
run; what is left over tries the next gap in the following round), updates the gaps and repeats. Where no piece fits any
gap, new sequences are opened by the longest pieces left. The tables of runs are bounded by the capacity, not by the
corpus: they hold at most one entry per length and per gap and number of rounds.

With an order of the documents, the places of each length are dealt to its pieces along it: sequences of equal filling are
spread evenly over 0 to 1, places and pieces of a length are matched by rank, and sequences are numbered by their earliest
piece. Reading them by number then follows the order as far as lengths allow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import read, slices, stored
from barloom.llm.tokens import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """One row per piece of each document's ids (text and end_id); only longer documents are cut, every `capacity` ids.

    order: name of a whole-number column that every piece takes from its document; the result has it last.
    """
    more = [] if order is None else [order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, at = encode(part.column("text"))
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(part.num_rows + 1)
                size = np.diff(at)
                cuts = -(-size // capacity)
                row = np.repeat(np.arange(part.num_rows), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                begin = at[row] + start
                crc = [zlib.crc32(ids[b : b + n].tobytes()) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), *(part.column(c).take(pa.array(row)) for c in more)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", *more])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(c).cast("long").alias(c) for c in more])
    return rows.mapInArrow(run, _schema(*more))


def _schema(*more: str) -> str:
    return ", ".join([PIECES, *(f"`{c}` long" for c in more)])


def plan_runs(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Place runs of pieces. lengths ascending (1 to capacity), counts of each.

    Returns placements (length, first rank, count, first sequence, offset), and the number of sequences.
    """
    left = np.zeros(capacity + 1, np.int64)
    left[lengths] = counts
    total = left.copy()
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
    out: list[tuple[int, int, int, int, int]] = []
    n_sequences = 0

    def place(length: int, count: int, sequence: int, offset: int, into: dict[int, list[tuple[int, int]]]) -> None:
        out.append((length, int(total[length] - left[length]), count, sequence, offset))
        left[length] -= count
        if capacity - offset - length:
            into.setdefault(capacity - offset - length, []).append((sequence, count))

    while left.any():
        # sweep: the successor gap of every length, longest first
        sizes = np.array(sorted(gaps), np.int64)
        todo = np.flatnonzero(left)[::-1]
        at = np.searchsorted(sizes, todo)
        fits = at < len(sizes)
        if not fits.any():
            # no piece fits: those over half the capacity open a sequence each, else enough of the longest for all that is left
            wide = todo[todo > capacity // 2]
            need = int(left[wide].sum()) or -(-int((left * np.arange(capacity + 1)).sum()) // capacity)
            for length in todo.tolist():
                count = min(need, int(left[length]))
                if not count:
                    break
                place(length, count, n_sequences, 0, gaps)
                n_sequences, need = n_sequences + count, need - count
            continue
        fresh: dict[int, list[tuple[int, int]]] = {}
        for length, k in zip(todo[fits].tolist(), at[fits].tolist(), strict=True):
            gap = int(sizes[k])
            runs = gaps.get(gap, [])
            while runs and left[length]:
                sequence, free = runs.pop()
                count = min(free, int(left[length]))
                if count < free:
                    runs.append((sequence + count, free - count))
                place(length, count, sequence, capacity - gap, fresh)
            if not runs:
                gaps.pop(gap, None)
        for gap, runs in fresh.items():  # gaps are updated once the round is over
            gaps.setdefault(gap, []).extend(runs)
    return np.array(out, np.int64).reshape(-1, 5), n_sequences


def _ranked(rows: DataFrame, order: str | None = None) -> DataFrame:
    """Rank of each piece among those of its length: place in its part of a range sort, plus the parts before."""
    more = [] if order is None else [order]

    rows = stored(rows, "pieces")  # a range sort reads its input twice: not the tokenizer
    return _ranked_by(rows, ("length", *more, "doc_id", "piece", "start", "ids_crc32"), _schema(*more))


def _ranked_by(rows: DataFrame, sort: tuple[str, ...], schema: str) -> DataFrame:
    """rows with their part of a range sort that begins with length, and their place in the part among those of their length."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            length = batch.column("length").to_numpy()  # sorted: runs of equal lengths
            edge = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1]))) if len(length) else np.empty(0, np.int64)
            size = np.diff(np.append(edge, len(length)))
            before = np.array([seen.get(int(length[e]), 0) for e in edge], np.int64)
            place = np.arange(len(length)) - np.repeat(edge - before, size)
            seen = {int(length[edge[-1]]): int(place[-1]) + 1} if len(edge) else seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int64)), pa.array(place, pa.int64())], [*batch.schema.names, "part", "place"])

    rows = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(number, schema + ", part long, place long")
    return stored(rows, "ranked")


def _before(ranked: DataFrame) -> DataFrame:
    """(length, part, n, before): rows of each length in each part and in the parts before it; capacity + parts rows at most."""
    parts = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    return parts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))


def _places(spark: SparkSession, runs: np.ndarray) -> DataFrame:
    """(length, rank, sequence_id, offset): the places of each length, ranked along the sequences of equal filling."""
    edges = np.unique(np.concatenate((runs[:, 3], runs[:, 3] + runs[:, 2])))  # between two of them all sequences are alike
    ends = np.cumsum(runs[:, 2])
    shared = spark.sparkContext.broadcast((runs, ends, edges))  # bounded by the capacity

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, ends, edges = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            k = np.searchsorted(ends, at, side="right")
            run = runs[k]
            sequence = run[:, 3] + at - (ends[k] - run[:, 2])
            i = np.searchsorted(edges, sequence, side="right") - 1
            jitter = (i * 0.6180339887498949) % 1  # groups of few sequences do not all stand in the middle
            along = (sequence - edges[i] + jitter) / (edges[i + 1] - edges[i])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (run[:, 0], along, sequence, run[:, 4])], ["length", "along", "sequence_id", "offset"])

    schema = "length long, along double, sequence_id long, offset long"
    rows = spark.range(int(ends[-1]) if len(ends) else 0).mapInArrow(make, schema)
    ranked = _ranked_by(rows, ("length", "along", "sequence_id", "offset"), schema)
    ranks = ranked.join(F.broadcast(_before(ranked).select("length", "part", "before")), ["length", "part"])
    return ranks.select("length", (F.col("before") + F.col("place")).alias("rank"), "sequence_id", "offset")


def _renumbered(placed: DataFrame, order: str) -> DataFrame:
    """Sequences numbered by their smallest `order`: place in its part of a range sort, plus the parts before."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("was"), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(seen, seen + n))], ["was", "part", "place"])
            seen += n

    placed = stored(placed, "placed")
    first = placed.groupBy(F.col("sequence_id").alias("was")).agg(F.min(order).alias("first"))
    first = first.repartitionByRange("first", "was").sortWithinPartitions("first", "was").select("was")
    first = stored(first.mapInArrow(number, "was long, part long, place long"), "sequences")
    parts = first.groupBy("part").agg(F.count("*").alias("n"))  # as many rows as parts
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    new = first.join(F.broadcast(parts), "part").select("was", (F.col("before") + F.col("place")).alias("new"))
    out = placed.join(new, F.col("sequence_id") == F.col("was"))
    return out.withColumn("sequence_id", F.col("new")).drop("was", "new", order)


def pack(rows: DataFrame, capacity: int = 4096, order: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32); see the module's text.

    Every piece is placed once: repeated rows are pieces of their own, ties are ordered by doc_id; no rows give no rows.
    order: column of `pieces` that ranks pieces of equal length and numbers the sequences, smallest first.
    """
    spark, more = rows.sparkSession, [] if order is None else [order]
    ranked = _ranked(rows, order)
    parts = _before(ranked)
    counts = sorted((r.length, r.n) for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect())  # capacity rows at most
    placed, _ = plan_runs(np.array([c[0] for c in counts], np.int64), np.array([c[1] for c in counts], np.int64), capacity)
    runs = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)  # bounded by the capacity

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = table[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    ranks = ranked.join(F.broadcast(parts.select("length", "part", "before")), ["length", "part"])
    ranks = ranks.select("doc_id", "piece", "start", "length", "ids_crc32", *more, (F.col("before") + F.col("place")).alias("rank"))
    if order is None:
        return ranks.mapInArrow(assign, _schema("sequence_id", "offset"))
    out = ranks.join(_places(spark, runs), ["length", "rank"])
    return _renumbered(out.select("doc_id", "piece", "start", "length", "ids_crc32", order, "sequence_id", "offset"), order)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 4,096 tokens."""
    return pack(pieces(read(spark, sf_dir, "documents", "doc_id", "text"), default_path("word_bpe_49k.json")))
