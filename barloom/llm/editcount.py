"""Edit-aware token counts (operator 5).

A document is cut into leaves of about `leaf_bytes` at spaces no pre-token reaches across, and a segment tree over the
leaves keeps the sums of characters and tokens. An edit finds its leaf by descending the character sums; only the leaves
it touches are encoded again, one more where the edit comes within _CONTEXT bytes of a border, since whether a border
still is one depends on the few bytes around it. The new counts go up the tree; all other subtrees stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import buffers, read, slices
from barloom.llm.tokens import cut_pieces, default_path, encoder

_CONTEXT = 8
TREE = "doc_id long, text string, borders array<int>, chars array<int>, tokens array<int>"
EDITS = "array<struct<at:int,remove:int,insert:string>>"


def heap(leaves: np.ndarray) -> np.ndarray:
    """Segment tree: node 1 is the root, nodes 2n and 2n + 1 are below n, the leaves fill the last level."""
    size = 1 << max(0, int(len(leaves) - 1).bit_length())
    tree = np.zeros(2 * size, np.int64)
    tree[size : size + len(leaves)] = leaves
    level = size
    while level > 1:
        tree[level // 2 : level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
        level //= 2
    return tree


def update(tree: list[int], leaf: int, value: int) -> None:
    """Set one leaf and the sums above it."""
    node = len(tree) // 2 + leaf
    change = value - tree[node]
    while node:
        tree[node] += change
        node //= 2


def find(tree: list[int], place: int) -> tuple[int, int]:
    """(leaf, place in it) of a place counted from the start; the end of all lies in the last leaf that isn't empty."""
    place = min(place, tree[1])
    at_end = place == tree[1] and place > 0
    place -= at_end
    node, size = 1, len(tree) // 2
    while node < size:
        node *= 2
        if place >= tree[node]:
            place -= tree[node]
            node += 1
    return node - size, place + at_end


def _leaf_borders(data: np.ndarray, at: np.ndarray, leaf_bytes: int) -> np.ndarray:
    """Borders of the leaves of texts on end: the first safe cut of every leaf_bytes of a text."""
    cuts = cut_pieces(data, at)
    text = np.searchsorted(at, cuts, side="right") - 1
    bucket = (cuts - at[text]) // leaf_bytes
    first = np.ones(len(cuts), bool)
    first[1:] = (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])
    return np.union1d(cuts[first], at)


def count_trees(docs: DataFrame, vocabulary: str, leaf_bytes: int = 512, doc_id: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """(doc_id, text, borders, chars, tokens[, carry]): the trees of every row; tokens[1] is the count of the whole text.

    borders: byte places of the leaves, the end included; chars, tokens: sums in heap order. Null and empty texts have
    one empty leaf; long ones more leaves; repeated rows a tree each; no rows give no rows; of further columns only the
    one named by `carry` is passed on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                data, at = buffers(part.column("text"))
                borders = _leaf_borders(data, at, leaf_bytes) if len(data) else np.zeros(1, np.int64)
                leaves = pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data)))
                tokens = np.diff(encode(leaves)[1])
                chars = np.diff(np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[borders])
                edge = np.searchsorted(borders, at)
                none = np.zeros(1, np.int64)
                rows = [
                    (borders[a : b + 1] - borders[a], heap(chars[a:b]), heap(tokens[a:b])) if b > a else (np.zeros(2, np.int64), heap(none), heap(none))
                    for a, b in zip(edge[:-1], edge[1:], strict=True)
                ]
                lists = [pa.array(list(c), pa.list_(pa.int32())) for c in (zip(*rows, strict=True) if rows else [()] * 3)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text").fill_null(""), *lists, *(part.column(c) for c in extra)], ["doc_id", "text", "borders", "chars", "tokens", *extra])

    extra = ["carry"] if carry else []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(carry).alias("carry")] if carry else []))
    schema = T.StructType([*T.StructType.fromDDL(TREE).fields, *(rows.schema[c] for c in extra)])
    out = rows.mapInArrow(run, schema)
    return out.withColumnRenamed("carry", carry) if carry else out


def _plan(text: bytes, borders: list[int], chars: list[int], edits: list[dict]) -> list[tuple[int, int, bytes]]:
    """(first leaf, last leaf, new bytes) of the regions that the edits touch, ascending and apart."""
    last = len(borders) - 2
    regions: list[list] = []  # first leaf, last leaf, [(start byte, stop byte, insert)]
    done = 0
    for edit in sorted(edits, key=lambda e: e["at"]):
        start = max(done, min(max(edit["at"], 0), chars[1]))
        stop = max(start, min(edit["at"] + max(edit["remove"], 0), chars[1]))
        done = stop
        places = []
        for place in (start, stop):
            leaf, inside = find(chars, place)
            leaf = min(leaf, last)
            body = text[borders[leaf] : borders[leaf + 1]]
            places.append((leaf, borders[leaf] + len(body.decode()[:inside].encode())))
        (a, at), (b, end) = places
        a -= a > 0 and at - borders[a] < _CONTEXT
        b += b < last and borders[b + 1] - end < _CONTEXT
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], b)
            regions[-1][2].append((at, end, edit["insert"] or ""))
        else:
            regions.append([a, b, [(at, end, edit["insert"] or "")]])
    out = []
    for a, b, changes in regions:
        parts, at = [], borders[a]
        for start, stop, insert in changes:
            parts += [text[at:start], insert.encode()]
            at = stop
        out.append((a, b, b"".join([*parts, text[at : borders[b + 1]]])))
    return out


def apply_edits(trees: DataFrame, vocabulary: str, edits: str = "edits") -> DataFrame:
    """(doc_id, text, borders, chars, tokens, n_before, n_tokens, n_leaves, n_touched, bytes_encoded) after the edits.

    `edits`: a column of arrays (at, remove, insert), places and lengths in characters of the text before any edit; they
    are clipped to the text, and an edit that starts in what another one removes starts behind it. Null arrays and
    inserts are empty. A region's new text stands in its first leaf, its other leaves become empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                columns = [part.column(c).to_pylist() for c in ("text", "borders", "chars", "tokens", "edits")]
                rows = [(t.encode(), b, c, k, e) for t, b, c, k, e in zip(*columns, strict=True)]
                plans = [_plan(t, b, c, e) if e else [] for t, b, c, _, e in rows]
                fresh = [new for plan in plans for _, _, new in plan]
                counts = iter(np.diff(encode(pa.array(fresh, pa.binary()).cast(pa.string()))[1]).tolist())
                done = []
                for (text, borders, chars, tokens, _), plan in zip(rows, plans, strict=True):
                    before, size, parts, at, moved = tokens[1], [b - a for a, b in zip(borders[:-1], borders[1:], strict=True)], [], 0, 0
                    for a, b, new in plan:
                        parts += [text[at : borders[a]], new]
                        at = borders[b + 1]
                        moved += len(new)
                        for leaf in range(a, b + 1):
                            size[leaf] = len(new) if leaf == a else 0
                            update(chars, leaf, len(new.decode()) if leaf == a else 0)
                            update(tokens, leaf, next(counts) if leaf == a else 0)
                    parts.append(text[at:])
                    done.append((b"".join(parts).decode(), np.concatenate(([0], np.cumsum(size))), chars, tokens, before, tokens[1], len(size), sum(b - a + 1 for a, b, _ in plan), moved))
                kinds = [pa.string(), *[pa.list_(pa.int32())] * 3, *[pa.int64()] * 5]
                made = [pa.array(list(c), k) for c, k in zip(zip(*done, strict=True) if done else [()] * 9, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", "text", "borders", "chars", "tokens", "n_before", "n_tokens", "n_leaves", "n_touched", "bytes_encoded"])

    rows = trees.select("doc_id", "text", "borders", "chars", "tokens", F.col(edits).cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, TREE + ", n_before long, n_tokens long, n_leaves long, n_touched long, bytes_encoded long")


def derived_edits(doc_id: str = "doc_id", text: str = "text", each: int = 3) -> Column:
    """Edits of a row made from the row itself: at hashed places, up to 40 characters go and up to 24 of another place
    come in."""
    n = F.coalesce(F.length(text), F.lit(0))
    some = lambda k, salt, below: F.pmod(F.xxhash64(F.lit(salt), doc_id, F.lit(k)), below).cast("int")
    one = lambda k: F.struct(
        some(k, "at", n + 1).alias("at"), some(k, "remove", F.lit(41)).alias("remove"),
        F.coalesce(F.substring(F.col(text), some(k, "from", n + 1) + 1, some(k, "insert", F.lit(25))), F.lit("")).alias("insert"))
    return F.array(*[one(k) for k in range(each)])


def op5_editcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits, and how much was encoded again."""
    vocabulary = default_path("byte_bpe_50k.json")
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("edits", derived_edits())
    edited = apply_edits(count_trees(docs, vocabulary, carry="edits"), vocabulary)
    return edited.select("doc_id", "n_before", "n_tokens", "n_leaves", "n_touched", "bytes_encoded")
