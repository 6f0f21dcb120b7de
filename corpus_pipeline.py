"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Every stage takes the rows its predecessor kept and returns the columns of documents (the last one: the packed pieces).
`run` writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import mixing, packing, quality, repeats, similar
from barloom.llm.common import stored
from barloom.llm.tokens import default_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents in a block of the mixture.
BLOCK_DOCS = 16
#: Words from which a passage that repeats is cut.
PASSAGE_WORDS = 50


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others pass unchanged."""
    return quality.keep_good(docs.select(*COLUMNS))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id, and of its texts the one of the smallest hash.
    Shingles of five words, exact Jaccard similarity of 0.8 or more, also over other documents: the SimHash links of operator 8
    are verified, and a prefix index adds the pairs whose fingerprints are too far apart. Rows with the same doc_id
    and text are one document, with the smallest of their other columns; rows without a doc_id cannot be named by a group
    and stay."""
    named = docs.select(*COLUMNS).filter("doc_id IS NOT NULL").withColumn("key", F.xxhash64("text"))
    groups = similar.similar_groups(named.select("key", "text"), size=5, percent=80)
    rows = named.select("doc_id", "key").distinct().join(groups, "key")
    stay = rows.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.*")
    kept = named.join(stay, ["doc_id", "key"], "left_semi")
    kept = kept.groupBy("doc_id", "key").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row"))
    return kept.select("doc_id", "row.*").select(*COLUMNS).union(docs.select(*COLUMNS).filter("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words and more that stand elsewhere too are cut out; n_chars follows the text. All documents
    stay, also those left empty."""
    row = F.struct(*[F.col(c) for c in COLUMNS]).alias("row")
    cut = repeats.remove_passages(docs.select("doc_id", "text", row), PASSAGE_WORDS, carry="row")
    same = F.col("n_removed") == 0
    out = cut.withColumn("new", F.when(same, F.col("row.text")).otherwise(F.col("kept_text")))
    return out.select("row.doc_id", F.col("new").alias("text"), "row.lang", "row.source", F.when(same, F.col("row.n_chars")).otherwise(F.length("new").cast("long")).alias("n_chars"))


def interleave(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their sources' mixture: files and rows follow the slots."""
    mixed = mixing.mix(docs.select(*COLUMNS), block_docs=BLOCK_DOCS)
    order = ("_slot", "_place", "_block", "source", "doc_id")
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4,096 tokens, numbered along the order of the rows handed over:
    by file, then by row in it. Rows that lie in no files have no order to hand over: they are mixed and written to some first."""
    try:
        docs = docs.select("doc_id", "text", "_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        docs = stored(interleave(spark, docs, sf_dir), "stage").select("doc_id", "text", "_metadata.file_name", "_metadata.row_index")
    # files are named by the task that wrote them and their number in it
    task, number = (F.coalesce(F.regexp_extract("file_name", p, 1).try_cast("long"), F.lit(0)) for p in (r"^part-(\d+)", r"-c(\d+)"))
    order = F.shiftleft(task, 43) + F.shiftleft(number, 32) + F.col("row_index")
    rows = packing.pieces(docs.select("doc_id", "text", order.alias("_order")), default_path("word_bpe_49k.json"), order="_order")
    return packing.pack(rows, order="_order")


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_distinct),
    ("repeated passages", cut_repeats),
    ("mixing", interleave),
    ("packing", pack),
]

#: SQL expresses neither suffix sorting nor these tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
