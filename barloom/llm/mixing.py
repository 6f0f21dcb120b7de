"""Mixing sources to target weights by Pfair scheduling (operator 9), DataFrame functions only.

Weights become whole numbers w with sum W. Block b of a source is released at floor(b * W / w) and due at
ceil((b + 1) * W / w). Every time slot goes to the released block with the earliest deadline, so no source is ever a whole
block ahead of or behind its share. The schedule repeats after W slots, which depend on the weights alone: it is made
once for that period, and a block finds its slot by its number in the period. Rows are numbered per source in two steps
(place in a hash range, plus the ranges before), so a source of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import read


def target_weights(sizes: DataFrame, alpha: float = 0.5, resolution: int = 1000) -> DataFrame:
    """(source, w) from (source, rows): shares of rows ** alpha in whole parts of `resolution`, at least 1."""
    share = F.pow(F.col("rows").cast("double"), alpha)
    total = sizes.agg(F.sum(share).alias("total"))
    w = F.greatest(F.lit(1), F.floor(resolution * share / F.col("total") + 0.5)).cast("long")
    return sizes.join(F.broadcast(total), F.lit(True)).select("source", w.alias("w"))  # total: one row


def period(weights: DataFrame) -> DataFrame:
    """(source, w, total, k, slot): the slot of each source's k-th block in one period of `total` slots.

    One row holds the weights; a fold over the slots keeps each source's count of blocks so far.
    """
    one = weights.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", "w"))).alias("s"))
    one = one.select("s", F.transform("s", lambda x: x["w"]).alias("ws"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["w"]).alias("total"))

    def pick(count: Column, t: Column) -> Column:
        total = F.col("total")
        due = F.transform(F.arrays_zip(count.alias("c"), F.col("ws").alias("w")), lambda x, i: F.struct(
            F.floor(((x["c"] + 1) * total + x["w"] - 1) / x["w"]).alias("deadline"), i.alias("i"), F.floor(x["c"] * total / x["w"]).alias("release")))
        return F.array_min(F.filter(due, lambda x: x["release"] <= t))["i"]

    def step(state: Column, t: Column) -> Column:
        chosen = F.array(pick(state["count"], t))
        return F.transform(chosen, lambda p: F.struct(
            F.transform(state["count"], lambda c, i: F.when(i == p, c + 1).otherwise(c)).alias("count"),
            F.concat(state["slots"], F.array(p)).alias("slots")))[0]

    start = F.struct(F.transform("ws", lambda w: w * 0).alias("count"), F.array().cast("array<int>").alias("slots"))
    made = one.select("s", "total", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), start, step)["slots"].alias("slots"))
    rows = made.select("s", "total", F.posexplode("slots").alias("slot", "i"))
    k = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1  # a period has a fixed number of slots
    return rows.select(F.col("s")[F.col("i")]["source"].alias("source"), F.col("s")[F.col("i")]["w"].alias("w"), "total", k.cast("long").alias("k"), F.col("slot").cast("long").alias("slot"))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, resolution: int = 1000, block_docs: int = 16,
    rows_per_range: int = 1000, most_ranges: int = 1 << 16, doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """`docs` with its place in the mixture: _block (of its source), _release, _due, _slot and _place (in the block).

    Reading by (_slot, _place) gives the mixture. Up to the slot where a first source ends, every source is less than one
    block from its share of the slots; then the slots of ended sources stay empty and all other rows follow, so no row is
    lost or repeated. weights (source, w whole number above 0) defaults to `target_weights` of the row counts; a source
    without a weight fails the job. Inside a source, rows are in order of the md5
    of doc_id; null doc_ids come last, repeated rows each keep a place of their own. A null source is a source like any
    other. No rows give no rows. Columns named as the added ones are refused; all others are passed on.
    """
    if taken := {"_block", "_release", "_due", "_slot", "_place"} & set(docs.columns):
        raise ValueError(f"columns of the result exist already: {sorted(taken)}")
    names = docs.columns
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(doc_id).alias("_id"), F.col(source).alias("_in"))
    doc_id, source = "_id", "_in"
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("rows"))
    weights = target_weights(sizes, alpha, resolution) if weights is None else weights
    table = period(weights).select(F.col("source").alias("_source"), "w", "total", "k", "slot")
    ranges = max(1, min(most_ranges, -(-docs.count() // rows_per_range)))
    key = F.coalesce(F.md5(F.col(doc_id).cast("string").cast("binary")), F.lit("g"))  # sorts behind hex digits
    at = F.coalesce(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double"), F.lit(float(2**32 - 1)))
    rows = docs.withColumn("_key", key).withColumn("_range", F.floor(at * ranges / 2**32).cast("int"))
    place = rows.groupBy(F.col(source).alias("_source"), "_range").agg(F.count("*").alias("_rows"))
    before = (F.sum("_rows").over(Window.partitionBy("_source").orderBy("_range")) - F.col("_rows")).alias("_before")
    place = place.select("_source", F.col("_range").alias("_r"), before)
    local = F.row_number().over(Window.partitionBy(source, "_range").orderBy("_key", doc_id)) - 1
    rows = rows.withColumn("_local", local)
    rows = rows.join(place, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r"))).drop("_source")
    number = F.col("_before") + F.col("_local")
    rows = rows.withColumn("_block", F.floor(number / block_docs)).withColumn("_place", (number % block_docs).cast("int"))
    w = table.select("_source", F.col("w").alias("_w"), F.col("total").alias("_total")).distinct()
    rows = rows.join(w, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")
    known = F.when(F.col("_w").isNotNull(), F.col("_w")).otherwise(F.raise_error(F.lit("a source has no weight")))
    rows = rows.withColumn("_k", F.col("_block") % known)
    table = table.select("_source", F.col("k").alias("_tk"), F.col("slot").alias("_ts"))
    rows = rows.join(table, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_k") == F.col("_tk")))
    return rows.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in names], "_block",
        F.floor(F.col("_block") * F.col("_total") / F.col("_w")).alias("_release"),
        F.floor(((F.col("_block") + 1) * F.col("_total") + F.col("_w") - 1) / F.col("_w")).alias("_due"),
        (F.floor(F.col("_block") / F.col("_w")) * F.col("_total") + F.col("_ts")).alias("_slot"), "_place")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mixture of its sources."""
    rows = mix(read(spark, sf_dir, "documents", "doc_id", "source"))
    return rows.select("doc_id", "source", F.col("_block").alias("block"), F.col("_release").alias("release"), F.col("_due").alias("due"), F.col("_slot").alias("slot"), F.col("_place").cast("int").alias("place"))


ORACLE_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weights AS (SELECT source, greatest(1, CAST(floor(1000 * sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) + 0.5) AS BIGINT)) AS w FROM sizes),
one AS (SELECT list(source ORDER BY source NULLS FIRST) AS names, list(w ORDER BY source NULLS FIRST) AS ws, CAST(sum(w) AS BIGINT) AS total FROM weights),
run AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS c, CAST(0 AS BIGINT) AS p FROM one
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END), pick
  FROM (SELECT t, c, list_sort(list_filter(
          list_transform(range(1, len(ws) + 1), lambda i: {'d': ((c[i] + 1) * total + ws[i] - 1) // ws[i], 'i': i, 'r': (c[i] * total) // ws[i]}),
          lambda x: x.r <= t + 1))[1].i AS pick FROM run, one WHERE t + 1 < total)
),
template AS (SELECT one.names[p] AS source, one.ws[p] AS w, one.total, t AS slot, row_number() OVER (PARTITION BY p ORDER BY t) - 1 AS k FROM run, one WHERE t >= 0),
numbered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)) NULLS LAST, doc_id) - 1 AS n FROM documents),
blocks AS (SELECT doc_id, source, n // 16 AS block, n % 16 AS place FROM numbered)
SELECT b.doc_id, b.source, CAST(b.block AS BIGINT) AS block, CAST((b.block * t.total) // t.w AS BIGINT) AS release,
       CAST(((b.block + 1) * t.total + t.w - 1) // t.w AS BIGINT) AS due,
       CAST((b.block // t.w) * t.total + t.slot AS BIGINT) AS slot, CAST(b.place AS INTEGER) AS place
FROM blocks b JOIN template t ON t.source IS NOT DISTINCT FROM b.source AND t.k = b.block % t.w
"""
