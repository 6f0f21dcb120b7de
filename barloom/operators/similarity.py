"""Similarity of one query row to all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def one_to_all(rows: DataFrame, target: DataFrame, vector: str) -> DataFrame:
    """Cosine similarity to a single target row, read as a scalar subquery."""
    one = target.select(vector).limit(1).scalar()
    return rows.withColumn("_q", one).withColumn("similarity", cosine(F.col(vector), F.col("_q"))).drop("_q")
