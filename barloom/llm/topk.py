"""Exact top-k search by multi-resolution segment statistics (operator 1).

A vector is cut into 1, 2, 4, ... equal segments; each segment keeps its mean m and deviation s. For two vectors q and c
the squared distance is at least sum(len * ((m_q - m_c)**2 + (s_q - s_c)**2)), coarse to fine ever closer. With the norms
known, that bounds the inner product from above:
    <q, c> = (|q|**2 + |c|**2 - d**2) / 2 <= sum(len * (m_q * m_c + s_q * s_c)).
A block of queries meets a block of vectors; the best bounds are scored first for a threshold, each level drops the
vectors no query can want, and the exact product is taken of the survivors only: in doubles where these are exact, in whole
numbers of any length for vectors with larger components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import read

_MOST = (1 << 63) - 1  # scores beyond a long are held at its ends


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double, held at the ends of a long; null if one is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(len) * mean and sqrt(len) * deviation of each segment, side by side: products of rows are the bound."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, a:b]
        out += [part.mean(axis=1) * np.sqrt(b - a), part.std(axis=1) * np.sqrt(b - a)]
    return np.stack(out, axis=1)


def _levels(dim: int) -> list[int]:
    return [n for n in (1, 2, 4, 8, 16, 32) if n * 2 <= dim] or [1]


def _products(q: np.ndarray, c: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Inner products as long of the wanted pairs of a query and a vector; elsewhere 0."""
    out = np.zeros((len(q), len(c)), np.int64)
    done = np.zeros_like(want)
    for bits, kind in ((53, np.float64), (63, np.int64)):  # sums of products below 2**bits are exact
        rows, cols = (np.flatnonzero(np.abs(x.astype(float)).max(axis=1) < 0.99 * math.sqrt(2.0**bits / x.shape[1])) for x in (q, c))
        if (~done & want)[np.ix_(rows, cols)].any():
            some = q[rows].astype(kind) @ c[cols].astype(kind).T
            out[np.ix_(rows, cols)] = some
        done[np.ix_(rows, cols)] = True
    for i, j in zip(*np.nonzero(want & ~done), strict=True):
        out[i, j] = max(-_MOST, min(_MOST, sum(x * y for x, y in zip(q[i].tolist(), c[j].tolist(), strict=True))))
    return out


def block_top(query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the k highest scores of every query in one block, ties to the smaller id."""
    order = np.argsort(vec_id, kind="stable")
    vec_id, c = vec_id[order], c[order]
    fq, fc = q.astype(float), c.astype(float)
    levels = _levels(q.shape[1])
    stats = [(segment_stats(fq, n), segment_stats(fc, n)) for n in levels]
    own = query_id[:, None] == vec_id[None, :]
    rows, cols, scores = [], [], []
    # rounding of statistics and products, against the largest size the product of two vectors can have
    slack = 1e-9 * np.outer(np.linalg.norm(fq, axis=1), np.linalg.norm(fc, axis=1))
    fine = np.where(own, -np.inf, stats[-1][0] @ stats[-1][1].T)  # the finest bound picks the vectors that set the threshold
    if fine.shape[1] >= k:
        seeds = np.argpartition(-fine, k - 1, axis=1)[:, :k]
        first = np.einsum("qkd,qd->qk", fc[seeds], fq) - np.take_along_axis(slack, seeds, axis=1)
        least = np.where(np.take_along_axis(own, seeds, axis=1), -np.inf, first).min(axis=1)
        least = np.minimum(least, float(1 << 62))  # scores held at the end of a long are ties
    else:
        least = np.full(len(q), -np.inf)
    alive = np.arange(len(vec_id))
    want = np.ones_like(own)
    for query_stats, vector_stats in stats:
        want = query_stats @ vector_stats[alive].T + slack[:, alive] >= least[:, None]
        keep = want.any(axis=0)
        alive, want = alive[keep], want[:, keep]
    want &= ~own[:, alive]
    exact = _products(q, c[alive], want)
    for i in range(len(q)):
        at = np.flatnonzero(want[i])
        at = at[np.argsort(-exact[i][at], kind="stable")[:k]]  # alive is in order of ids
        rows.append(np.full(len(at), i))
        cols.append(order[alive[at]])
        scores.append(exact[i][at])
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    return join(rows), join(cols), join(scores)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 4096, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all vectors but those of its own id.

    vectors, queries: an id and an array of whole numbers (see `scaled`). Vectors of other lengths than the query's are no
    candidates; null or empty vectors and null ids take no part. Every row counts: rows of one id are candidates each, equal ones as often
    as they occur; equal query rows are one query, different ones of one id share one list. Fewer than k candidates give fewer rows; scores beyond a long are
    held at its ends and tie there. Equal rows travel once with their number, blocks hold about `block` different rows of
    either side, so a task's memory does not grow with the tables; every query block meets every vector block once.
    """
    def blocks(df: DataFrame) -> tuple[DataFrame, int]:
        df = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v")).na.drop().filter(F.size("v") > 0)
        df = df.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k).cast("long")).alias("m"))
        n = max(1, -(-df.count() // block))
        return df.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")), n

    left, n_left = blocks(queries)
    right, n_right = blocks(vectors)
    left = left.select("id", "v", "m", F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("vb"))
    right = right.select("id", "v", "m", F.col("block").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("qb"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        for dim in np.unique(_sizes(a)) if a.num_rows and b.num_rows else ():
            (qi, _, q), (vi, vm, c) = _matrix(a, dim), _matrix(b, dim)
            for start in range(0, len(qi), 512):
                if len(vi):
                    i, j, s = block_top(qi[start : start + 512], q[start : start + 512], vi, c, k)
                    found.append(pa.table({"query_id": qi[start + i], "vec_id": vi[j], "score": s, "m": vm[j]}))
        return pa.concat_tables(found) if found else pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score", "m")})

    pairs = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, "query_id long, vec_id long, score long, m long")
    pairs = pairs.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sizes(t: pa.Table) -> np.ndarray:
    return np.diff(t.column("v").combine_chunks().offsets.to_numpy())


def _matrix(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    keep = pa.array(np.diff(v.offsets.to_numpy()) == dim)
    rows = v.filter(keep)
    ids, times = (t.column(n).combine_chunks().filter(keep).to_numpy() for n in ("id", "m"))
    return ids, times, rows.flatten().to_numpy().reshape(-1, dim)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest scores of every vector whose id is divisible by 20."""
    table = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", scaled(F.col("embedding")).alias("vector"))
    return top_k(table, table.filter("vec_id % 20 = 0"))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""
