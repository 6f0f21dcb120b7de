"""SimHash near-duplicates over a byte-position inverted index with count filtering (operator 8).

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight bytes, so they share
five positional bytes at least. Lists of single bytes (2,048 keys) would grow with the square of the corpus, so the index
has one list per combination of five positions and their bytes: a pair meets in a list exactly if its tally of shared
positional bytes reaches the guaranteed minimum. Inside a list the tally is counted, the pair is taken in the first list
both stand in, and the differing bits are verified. A list holds distinct fingerprints only, so 2**24 at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import read, slices, stored
from barloom.llm.components import components

SEED = 42
SUBSETS = np.array(list(combinations(range(8), 5)))  # 56 lists for each fingerprint
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of one text; the whole sequence if it is shorter; none for no words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, len(words) - size + 1)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes: a bit is set if over half of the run's hashes have it; zero for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    parts = -(-n // 255)  # byte lanes hold 255 at most
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    bits = np.zeros(len(full), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, cuts)
        ones = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            bits |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + j)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes = [shingle_hashes(t or b"", size) for t in part.column("text").to_pylist()]
                fp = majority_bits(np.concatenate(hashes), np.array([len(h) for h in hashes]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every linked node to the smallest of its component: as many as nodes, however many links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return label[moved], moved


def _close(a: np.ndarray, b: np.ndarray, subset: int | np.ndarray, most_bits: int) -> np.ndarray:
    """Pairs to keep: tally of shared bytes reached, list is the first both stand in, differing bits verified."""
    diff = a ^ b
    same = diff.view(np.uint8).reshape(-1, 8) == 0
    rank = np.cumsum(same, axis=1)
    here = np.zeros((len(a), 8), bool)
    np.put_along_axis(here, np.broadcast_to(SUBSETS[subset], (len(a), 5)), True, axis=1)
    first = ((same & (rank <= 5)) == here).all(axis=1)
    return (same.sum(axis=1) >= 5) & first & (np.bitwise_count(diff) <= most_bits)


def _long_run(fp: np.ndarray, subset: int, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one long list of sorted fingerprints: look up every fingerprint that differs in up to most_bits bits
    outside the list's five bytes, so time is linear in the list."""
    free = [8 * byte + bit for byte in range(8) if byte not in SUBSETS[subset] for bit in range(8)]
    left, right = [], []
    label_i, label_j = np.empty(0, np.int64), np.empty(0, np.int64)
    for k in range(1, most_bits + 1):
        for bits in combinations(free, k):
            other = fp ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
            hit = np.flatnonzero((fp[at] == other) & (fp < other))
            left.append(hit)
            right.append(at[hit])
        label_i, label_j = _spanning(len(fp), np.concatenate([label_i, *left]), np.concatenate([label_j, *right]))
        left, right = [], []
    return fp[label_i], fp[label_j]


def _links(key: np.ndarray, fp: np.ndarray, most_bits: int, short: int = 8, long: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside the runs of equal keys; (key, fp) sorted, fp unsigned."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    subset = (key >> np.uint64(40)).astype(np.int64)
    small = np.repeat(size <= short, size)
    for k in range(1, short):
        i = np.flatnonzero((key[:-k] == key[k:]) & small[:-k]) if len(key) > k else np.empty(0, np.int64)
        if not len(i):
            break
        keep = _close(fp[i], fp[i + k], subset[i], most_bits)
        yield fp[i[keep]], fp[i[keep] + k]
    for r in np.flatnonzero(size > short):
        own, s = fp[edge[r] : edge[r + 1]], int(subset[edge[r]])
        if len(own) > long:
            yield _long_run(own, s, most_bits)
            continue
        left, right = [], []
        for k in range(1, len(own)):
            keep = np.flatnonzero(_close(own[:-k], own[k:], s, most_bits))
            left.append(keep)
            right.append(keep + k)
        i, j = _spanning(len(own), np.concatenate(left), np.concatenate(right))
        yield own[i], own[j]


def link_fingerprints(prints: DataFrame, most_bits: int = 3) -> DataFrame:
    """(a, b): links that join all distinct values of `fp` within most_bits (up to 3) differing bits.

    In a list with many close values a spanning set of the links is returned, never all pairs.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("five shared bytes are guaranteed for up to three bits only")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.uint64), np.empty(0, np.uint64)
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def out(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in _links(k, f, most_bits) if len(k) else ():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        for batch in batches:
            k = np.concatenate((held_k, batch.column(0).to_numpy().view(np.uint64)))
            f = np.concatenate((held_f, batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)))
            cut = int(np.searchsorted(k, k[-1]))  # the last run may go on
            yield from out(k[:cut], f[:cut])
            held_k, held_f = k[cut:], f[cut:]
        yield from out(held_k, held_f)

    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = []
    for s, subset in enumerate(SUBSETS):
        key = F.lit(s << 40).cast("long")
        for place, p in enumerate(subset):
            key = key.bitwiseOR(F.shiftleft(byte[int(p)], 8 * place))
        keys.append(key)
    flip = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # so that signed order is the order of bits
    lists = prints.select("fp").distinct().select(F.explode(F.array(*keys)).alias("k"), flip.alias("f"))
    return lists.repartition("k").sortWithinPartitions("k", "f").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, most_bits: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, fp long, component_id long).

    component_id: the smallest doc_id reachable over links of fingerprints that differ in up to most_bits bits, the own
    one included. Null and empty texts have fingerprint 0 and link like any other; repeated rows and equal texts share
    a fingerprint and so a component; a null doc_id is never a component id unless all ids of the component are null;
    an empty table gives no rows; further columns of `docs` are not read.
    """
    prints = stored(fingerprints(docs, size, doc_id, text), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    label = components(link_fingerprints(prints, most_bits))
    classed = distinct.join(label, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    named = classed.groupBy("label").agg(F.min("low").alias("component_id"))
    return prints.join(classed.join(named, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
