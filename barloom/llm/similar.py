"""Near-duplicates by the exact Jaccard similarity of their shingle sets (second stage of the pipeline).

Pairs come first from operator 8: SimHash fingerprints of the shingles, linked over its byte-position inverted index with
count filtering. Fingerprints of similar sets may differ in more bits than it links, so a prefix index finds the pairs left.

All shingles get one order: those a sample of the documents shows to be frequent last, the others by hash. Of two sets of n
and m shingles with a similarity of t or more, the first n - ceil(t * n) + 1 and m - ceil(t * m) + 1 in that order have one
in common (prefix filter), whatever the order is. The index has one list per shingle of these prefixes, so no pair is
missed. Pairs whose sizes or places rule the similarity out are passed over; all others are verified on the whole sets.

A list of many near copies is not paired out: every set is first verified against those its fingerprint links it with and the
leaders of two of its lists, then only pairs whose ends are in different components are. Equal sets are one node. A signature of 512 parity bits goes before
every verification: the sets of a pair differ in at least as many shingles as their signatures differ in bits, so pairs whose
bits differ too much are out for sure and neither leave their task nor meet their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import slices, stored
from barloom.llm.components import components
from barloom.llm.simhash import fingerprints, link_fingerprints, shingle_hashes

_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SIGNS = [f"g{i}" for i in range(8)]  # 64 bits each


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, size))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("key", F.col("text").cast("binary").alias("text"))


def signature(shingles: np.ndarray) -> np.ndarray:
    """512 bits: whether an odd number of the shingles falls on each."""
    odd = np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=64 * len(_SIGNS)).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def nodes(docs: DataFrame, size: int) -> DataFrame:
    """(key, node, n, g0 … g7) of every row of docs (key, text): equal shingle sets are one node, n is their size, g their
    signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t or b"", size) for t in part.column("text").to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                signs = np.stack([signature(s) for s in sets])
                columns = [part.column("key"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, np.ascontiguousarray(signs.T))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "n", *_SIGNS])

    return _rows(docs).mapInArrow(run, "key long, node long, n long, " + ", ".join(f"{g} long" for g in _SIGNS))


def _frequent(docs: DataFrame, size: int, one_in: int = 8, least: int = 6, most: int = 1 << 20) -> np.ndarray:
    """Up to `most` shingles of the highest counts in a sample of the documents; they only set the order, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t or b"", size) for t in part.column("text").to_pylist()]
                found, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["s", "n"])

    sample = _rows(docs.filter(F.pmod("key", F.lit(one_in)) == 0))
    counted = sample.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    top = counted.orderBy(F.desc("n"), "s").limit(most).select("s").toArrow().column("s").to_numpy()
    return np.sort(top.view(np.uint64))


def _postings(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(s, node, n, at): the shingles of every set's prefix, with their place in it."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                out: list[list[np.ndarray]] = [[], [], [], []]
                for text in part.column("text").to_pylist():
                    s = shingle_set(text or b"", size)
                    n = len(s)
                    if not n:
                        continue
                    if len(last):
                        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        order = np.concatenate((s[~late], s[late]))
                    else:
                        order = s
                    p = n + percent * n // -100 + 1
                    node = np.array(xxhash.xxh64_intdigest(s.tobytes()), np.uint64).view(np.int64)
                    for to, x in zip(out, (order[:p].view(np.int64), np.full(p, node), np.full(p, n), np.arange(p)), strict=True):
                        to.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["s", "node", "n", "at"])

    return _rows(docs).mapInArrow(run, "s long, node long, n long, at long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of batches, cut so that no run of equal values of the first column is split."""
    held: list[np.ndarray] = []
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        if not len(held[0]):
            continue
        cut = int(np.flatnonzero(held[0] == held[0][-1])[0])
        if cut:
            yield tuple(x[:cut] for x in held)
            held = [x[cut:] for x in held]
    if held and len(held[0]):
        yield tuple(held)


def _lists(postings: DataFrame) -> DataFrame:
    """(s, node, n, at, leader, leader_n, leader_at) of the lists with two nodes or more; a list's leader is one of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, r, node, n, at in _runs(batches):
            new = np.concatenate(([True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])))  # repeated texts stand side by side
            s, node, n, at = s[new], node[new], n[new], at[new]
            edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            count = np.diff(np.append(edge, len(s)))
            first, keep = np.repeat(edge, count), np.repeat(count > 1, count)
            first = first[keep]
            columns = (s[keep], node[keep], n[keep], at[keep], node[first], n[first], at[first])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["s", "node", "n", "at", "leader", "leader_n", "leader_at"])

    rows = postings.select("s", F.xxhash64("s", "node").alias("r"), "node", "n", "at")
    rows = rows.repartition("s").sortWithinPartitions("s", "r", "node")
    return stored(rows.mapInArrow(run, "s long, node long, n long, at long, leader long, leader_n long, leader_at long"), "lists")


def _can(n, at, m, to, percent: int):
    """Whether sets of n and m shingles that first meet at places `at` and `to` can be similar; columns or arrays.

    A similarity of p % needs an overlap of p / (100 + p) of both sizes together.
    """
    low = F.least(n - at, m - to) if not isinstance(n, np.ndarray) else np.minimum(n - at, m - to)
    return (100 + percent) * low >= percent * (n + m)


def _alike(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures allow the similarity: a similarity of p % leaves (100 - p) / (100 + p) of both sizes
    together to differ in."""
    for end in "ab":
        pairs = pairs.join(signs.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), *(F.col(g).alias(f"{g}{end}") for g in _SIGNS)), end)
    differ = sum((F.bit_count(F.col(f"{g}a").bitwiseXOR(F.col(f"{g}b"))) for g in _SIGNS), F.lit(0))
    return pairs.filter((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def _cross(lists: DataFrame, label: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of a list that can be similar and whose ends are in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, of, node, n, at, *signs in _runs(batches):
            bits = np.stack(signs, axis=1).view(np.uint64)
            edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            for start, stop in zip(edge[:-1], edge[1:], strict=True):
                if of[start] == of[stop - 1]:
                    continue  # sorted by component: one component only
                group = np.flatnonzero(np.concatenate((of[start + 1 : stop] != of[start : stop - 1], [True]))) + start + 1  # ends
                for i in range(start, int(group[-2]) if len(group) > 1 else start):
                    j = np.arange(group[np.searchsorted(group, i, side="right")], stop)
                    j = j[_can(np.full(len(j), n[i]), at[i], n[j], at[j], percent)]
                    differ = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
                    j = j[(100 + percent) * differ <= (100 - percent) * (n[i] + n[j])]
                    if len(j):
                        low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], schema=_PAIR)

    of = lists.select("s", "node", "n", "at").join(label.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    of = of.select("s", F.coalesce("label", "node").alias("of"), "node", "n", "at")
    # most lists lie in one component: they go before the sort
    mixed = of.groupBy("s").agg(F.min("of").alias("x"), F.max("of").alias("y")).filter("x < y").select("s")
    rows = of.join(mixed, "s", "left_semi").join(signs.select("node", *_SIGNS), "node").select("s", "of", "node", "n", "at", *_SIGNS)
    rows = rows.repartition("s").sortWithinPartitions("s", "of", "node")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes with a similarity of `percent` or more; texts: (node, text) of one row of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = shingle_set(x or b"", size), shingle_set(y or b"", size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _printed(docs: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """(a, b): links of nodes whose SimHash fingerprints differ in three bits or fewer. Nodes of one fingerprint are linked with
    the smallest of them, which stands for the fingerprint in its links with others."""
    prints = fingerprints(docs, size, doc_id="key").withColumnRenamed("doc_id", "key").distinct()
    prints = stored(prints.join(known.select("key", "node"), "key").select("node", "fp").distinct(), "prints")
    first = prints.groupBy("fp").agg(F.min("node").alias("first"))
    same = prints.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = link_fingerprints(prints)
    for end in "ab":
        near = near.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"node_{end}")), end)
    pairs = same.union(near.select("node_a", "node_b"))
    return pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(key, group) for every distinct key of docs (key: hash of the text, long; text).

    group: equal for keys that are joined over texts whose shingle sets have a Jaccard similarity of `percent` or more.
    Null and empty texts have no shingles and are one group; no rows give no rows.
    """
    known = stored(nodes(docs, size).distinct(), "nodes")
    lists = _lists(_postings(docs, size, percent))
    # a node is verified with those its fingerprint links it with and the leaders of two of its lists
    led = lists.filter("node != leader").filter(_can(F.col("n"), F.col("at"), F.col("leader_n"), F.col("leader_at"), percent))
    led = led.select("node", "leader").distinct()
    turn = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("leader", "node"), "leader"))
    led = led.withColumn("turn", turn).filter("turn <= 2").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    led = led.union(_printed(docs, known, size)).distinct()
    signs = known.dropDuplicates(["node"]).select("node", "n", *_SIGNS)
    led = stored(_alike(led, signs, percent), "led")
    held = lists.select("node").union(led.select("a")).union(led.select("b")).distinct()
    held = known.join(held, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    texts = docs.select("key", F.col("text").cast("binary").alias("text")).join(held, "key").dropDuplicates(["node"]).select("node", "text")
    texts = stored(texts, "held")
    links = stored(_verified(led, texts, size, percent), "verified")
    cross = _cross(lists, components(links), signs, percent).join(led, ["a", "b"], "left_anti")
    links = links.union(stored(_verified(cross, texts, size, percent), "verified"))
    label = components(links)
    return known.join(label, "node", "left").select("key", F.coalesce("label", "node").alias("group"))
