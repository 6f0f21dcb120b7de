"""Interaction of five filters over all orders of applying them (operator 11).

Four filters judge a text alone. The fifth, "identical to the text of a smaller doc_id", needs all texts, so a counting
Bloom filter goes first:

1. Every task counts the cells of its texts' hashes, at 2 at most. The sketch is cut into blocks; a task hands over only
   the cells it touched, and equal blocks are added up. What stays is one bit per cell: counted twice or more.
2. A text with a cell counted once is unique for sure. Only the others, possible repeats, are shuffled: grouped by their
   full text, partial groups first, each group giving its smallest doc_id.
3. Rows are then counted by the mask of the filters they fail. Masks add up, so every order and step is a sum over at most
   32 masks of a part, and a filter's share over all 120 orders is 120 / (filters failed) for every row failing it.

The sketch has at most `most_cells` bits, which bounds what is broadcast. Beyond `most_cells / cells_per_doc` documents
more texts stay possible repeats; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import discard, read, stored

FILTERS = "ABCDE"
_WORD_BREAK = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLOCK = 15  # bits of a cell's place in its block
_HASHES = 3


def failed_alone(text: Column) -> Column:
    """Mask of the filters A to D that a text fails: bit 0 for A (under 200 words), 1 for B (distinct words under half), 2 for
    C (capitals over 3 % of code points), 3 for D (one of #$%&*|)."""
    words = F.filter(F.split(text, _WORD_BREAK), lambda w: w != "")

    def mask(w: Column) -> Column:
        n, distinct = F.size(w), F.size(F.array_distinct(w))
        capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
        fails = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]"))
        return sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))

    return F.transform(F.array(words), mask)[0]  # the words are made once


def _cell(h: Column, i: int, blocks: int) -> tuple[Column, Column]:
    """(block, cell in it) of a hash; all cells of a text are in one block."""
    return F.shiftrightunsigned(h, 40) % blocks, F.shiftright(h, 13 * i).bitwiseAND((1 << _BLOCK) - 1)


def repeat_sketch(hashes: DataFrame, rows: int, cells_per_doc: int = 16, most_cells: int = 1 << 28) -> tuple[DataFrame, int]:
    """(block, twice) and the number of blocks: the cells of `h` counted twice or more, as 64-bit words."""
    size = 1 << _BLOCK
    blocks = max(1, min(most_cells, rows * cells_per_doc) // size)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            cell, times = np.unique(np.concatenate(held), return_counts=True)
            cell = np.repeat(cell, np.minimum(times, 2))
            edge = np.flatnonzero(np.concatenate(([True], cell[1:] >> _BLOCK != cell[:-1] >> _BLOCK)))
            low = (cell & (size - 1)).astype(np.uint16)
            made = [x.tobytes() for x in np.split(low, edge[1:])]
            for at in range(0, len(edge), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(cell[edge[part]] >> _BLOCK), pa.array(made[part], pa.binary())], ["block", "cells"])

        for batch in batches:
            h = batch.column("h").to_numpy()
            block = (h.view(np.uint64) >> np.uint64(40)).astype(np.int64) % blocks << _BLOCK
            held += [block | (h >> 13 * i & (size - 1)) for i in range(_HASHES)]
            n += len(h) * _HASHES
            if n > 4_000_000:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def merged(table: pa.Table) -> pa.Table:
        count = np.zeros(size, np.uint8)
        for cells in table.column("cells").to_pylist():
            cell, times = np.unique(np.frombuffer(cells, np.uint16), return_counts=True)
            count[cell] = np.minimum(count[cell] + times, 2)
        twice = np.packbits(count == 2, bitorder="little").view(np.int64)
        return pa.table({"block": table.column("block").slice(0, 1), "twice": pa.array([twice], pa.list_(pa.int64()))})

    counted = hashes.select("h").mapInArrow(partial, "block long, cells binary")
    return counted.groupBy("block").applyInArrow(merged, "block long, twice array<long>"), blocks


def _possible(rows: DataFrame, sketch: DataFrame, blocks: int) -> DataFrame:
    """`rows` whose hash `h` has no cell counted once."""
    block, _ = _cell(F.col("h"), 0, blocks)
    both = rows.join(F.broadcast(sketch.withColumnRenamed("block", "_block")), block == F.col("_block"))
    for i in range(_HASHES):
        _, cell = _cell(F.col("h"), i, blocks)
        word = F.element_at("twice", F.shiftright(cell, 6).cast("int") + 1)
        both = both.filter(F.getbit(word, cell.bitwiseAND(63).cast("int")) == 1)
    return both.drop("_block", "twice")


def mask_counts(docs: DataFrame, labels: DataFrame, most_cells: int = 1 << 28) -> DataFrame:
    """(part, mask, n, good, toxic): rows of `docs` (doc_id, text, lang) by language and the filters they fail.

    Null texts are empty, null languages the empty string. Rows without a doc_id neither fail E nor make others fail it;
    rows of one doc_id and text are no repeats of each other. A document is good (toxic) if any of its labels says so.
    Further columns are not read.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    texts = docs.select("doc_id", text, F.xxhash64(text).alias("h"))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("h"), failed_alone(text).alias("mask"))
    rows = stored(rows, "masks")
    sketch, blocks = repeat_sketch(rows.filter("doc_id IS NOT NULL"), rows.count(), most_cells=most_cells)
    sketch = stored(sketch, "sketch")
    # of each full text, the smallest doc_id is the one that stays
    first = _possible(texts.filter("doc_id IS NOT NULL"), sketch, blocks).groupBy("h", "text").agg(F.min("doc_id").alias("doc_id"))
    first = stored(first.select("doc_id", "h"), "first").distinct().withColumn("first", F.lit(True))
    again = _possible(rows.filter("doc_id IS NOT NULL").select("doc_id", "h"), sketch, blocks).distinct()
    again = stored(again.join(first, ["doc_id", "h"], "left").filter("first IS NULL").select("doc_id", "h", F.lit(16).alias("e")), "again")
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(again, ["doc_id", "h"], "left").join(known, "doc_id", "left")
    made = rows.groupBy("part", (F.col("mask") + F.coalesce("e", F.lit(0))).alias("mask")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    out = stored(made, "counts")
    discard(sketch, again)
    return out


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, n, good, toxic)."""
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))).alias("filter_order")
    rows = counts.select("*", orders)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    def bit(step: Column) -> Column:
        letter = F.substring("filter_order", step, F.lit(1))
        return F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))

    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda a, i: a + F.when(i < F.col("step"), bit(i)).otherwise(0))
    rows = rows.withColumns({"bit": bit(F.col("step")), "before": before})
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(rule: Column, of: Column | str = "n") -> Column:
        return F.sum(F.when(rule, F.col(of) if isinstance(of, str) else of).otherwise(0)).cast("long")

    share = (F.col("n") * 120 / F.nullif(F.bit_count("mask"), F.lit(0))).cast("long")  # 120 divides by 1 to 5
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"), total(fails, share).alias("shapley"))


def op11_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language, order and step of the five filters over all documents."""
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text", "lang"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return audit(mask_counts(docs, labels))


ORACLE_SQL = r"""
WITH RECURSIVE known AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
judged AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
masks AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask
  FROM judged),
counts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || letter FROM orders, letters WHERE length(o) < 5 AND NOT contains(o, letter)),
steps AS (
  SELECT o AS filter_order, CAST(s AS INTEGER) AS step, CAST(2 ** (instr('ABCDE', o[s]) - 1) AS INTEGER) AS bit,
    CAST(list_sum(list_transform(range(1, s), lambda i: 2 ** (instr('ABCDE', o[i]) - 1))) AS INTEGER) AS before
  FROM orders, range(1, 6) AS r(s) WHERE length(o) = 5)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (mask & (bit | coalesce(before, 0)) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mask & bit != 0 AND mask & coalesce(before, 0) = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & bit != 0 AND mask & coalesce(before, 0) != 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & bit != 0 AND mask & coalesce(before, 0) = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (mask & bit != 0 AND mask & coalesce(before, 0) = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // nullif(bit_count(mask), 0)) FILTER (mask & bit != 0), 0) AS BIGINT) AS shapley
FROM counts, steps GROUP BY part, filter_order, step
"""
