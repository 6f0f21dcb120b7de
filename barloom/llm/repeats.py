"""Removal of repeated passages by a distributed suffix array (operator 3).

A byte goes if it lies in a string of `width` bytes that also starts anywhere else. The steps:

1. Every window of `width` bytes is known by its smallest 64-byte gram. Equal windows have equal smallest grams, so
   windows whose gram stands nowhere else are out; runs of the others make regions. This only discards.
2. Regions are cut into phrases at the smallest 32-byte grams of short windows, places that equal strings share. The
   phrases are symbols, and the difference-cover algorithm (`suffixes`) sorts all suffixes of the regions.
3. Adjacent suffixes compare their prefixes. If two windows are equal, the suffixes at their first phrase border share
   the phrases of the next `_REACH` bytes, so a suffix that shares them with neither neighbour serves no repeated window.
4. The suffixes left over are compared byte by byte: blocks (all windows a suffix serves) first, and window by window
   where a block stands alone among others of its prefix. Digests of 128 bits stand for the bytes.

Texts are read whole; long ones are taken in overlapping pieces, so memory per text is bounded in steps 1 and 2.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import buffers, discard, read, slices, stored
from barloom.llm.suffixes import suffix_ranks

_COARSE, _FINE, _SHORT = 64, 16, 108  # bytes of the grams, grams in a short window
_REACH = 400 - _FINE - 3 * _SHORT + 2  # bytes after the first border whose phrases equal windows share; see _phrases
_CELL = 9  # windows compared as one inside a block
_SYMBOLS = 9  # most symbols of a prefix: the order of suffixes is needed to this depth only
_IDX = 20  # low bits of a packed gram hold its place in the piece
_PIECE = (1 << _IDX) - 4096
_GROUP = 1 << 15  # bytes of short texts looked through at once
_TYPES = {"int64": T.LongType(), "string": T.StringType(), "binary": T.BinaryType()}
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_MIX = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of `size` (a power of two) bytes."""
    x, n = _MIX[data], 1
    while n < size:
        y = x[:-n] * np.uint64(0x9E3779B97F4A7C15)
        y += x[n:]
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        x, n = y, 2 * n
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


_LOW = np.uint64((1 << _IDX) - 1)


def _placed(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash (44 bits) and place of every gram, packed."""
    return _grams(data, gram) & ~_LOW | np.arange(len(data) - gram + 1, dtype=np.uint64)


def _pieces(data: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, bytes): pieces that hold each window of the text once."""
    for start in range(0, max(0, len(data) - width + 1), _PIECE):
        yield start, data[start : start + _PIECE + width - 1]


def _groups(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, stop): texts on end, at[i] to at[i + 1] each, that hold _GROUP bytes together or are one text."""
    first, n = 0, len(at) - 1
    while first < n:
        stop = max(first + 1, int(np.searchsorted(at, at[first] + _GROUP, side="right")) - 1)
        yield first, stop
        first = stop


def _window_runs(data: np.ndarray, at: np.ndarray, width: int) -> list[tuple[np.ndarray, ...]]:
    """(text, smallest gram, first window, last window, places of it: 1 or 2 for more) of the runs of windows alike in it.

    The texts lie on end in data, from at[i] to at[i + 1] each; windows lie in one text.
    """
    out = []
    for start, piece in _pieces(data, width):
        left = _placed(piece, _COARSE)
        right = _least(left ^ _LOW, width - _COARSE + 1)
        left = _least(left, width - _COARSE + 1)
        value = left >> np.uint64(_IDX)
        text = np.full(len(value), -1)  # -1: the window reaches beyond its text
        for i in range(int(np.searchsorted(at, start, side="right")) - 1, len(at) - 1):
            if at[i] >= start + len(value):
                break
            text[max(0, at[i] - start) : max(0, at[i + 1] - width + 1 - start)] = i
        edge = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (text[1:] != text[:-1]))))
        end = np.append(edge[1:], len(value))
        place = lambda x: (x & _LOW).astype(np.int64)
        many = np.minimum.reduceat(place(left), edge) != np.maximum.reduceat(place(right ^ _LOW), edge)
        of = text[edge]
        runs = (of, value[edge].astype(np.int64), start + edge - at[of], start + end - 1 - at[of], 1 + many)
        out.append(tuple(x[of >= 0] for x in runs))
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans [start, stop), those that touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _candidates(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The stored runs of all windows, and (doc_id, th, runs): windows (first, last) of each text whose smallest gram stands elsewhere too."""
    schema = "doc_id long, th long, v long, first int, last int, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                data, at = buffers(part.column("body"))
                found = []
                for i, stop in _groups(at):
                    for of, *runs in _window_runs(data[at[i] : at[stop]], at[i : stop + 1] - at[i], width):
                        found.append((i + of, *runs))
                if found:
                    of, v, first, last, n = (np.concatenate(c) for c in zip(*found, strict=True))
                    row = pa.array(of)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(row), part.column("th").take(row), pa.array(v), *(pa.array(x.astype(np.int32)) for x in (first, last, n))],
                        [c.split()[0] for c in schema.split(", ")])

    rows = stored(docs.mapInArrow(run, schema), "windows")
    again = rows.groupBy("v").agg(F.sum("n").alias("n")).filter("n > 1").select("v")
    kept = rows.join(again, "v", "left_semi")
    return rows, kept.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # bounded by the text


def _phrases(region: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]:
    """Borders, served windows and symbols of one region.

    (border, fewest and most bytes a served window starts before it (-1: it serves none), symbols, prefix digests). A
    window starting at p is served by the border of the short window at p, at most _SHORT - 1 bytes on. Borders up to
    p + width - (_SHORT + _FINE - 1) depend on the window's bytes alone. A border a that serves p stands before
    p + _SHORT, and borders stand at most _SHORT apart: the first border at a + _REACH or later is among them for
    width 400. The phrases up to it, _SYMBOLS at most, are the prefix that suffixes of equal windows share.
    """
    borders_l: list[np.ndarray] = []
    serving: list[np.ndarray] = []
    data = np.frombuffer(region, np.uint8)
    short = _SHORT + _FINE - 1
    for start, piece in _pieces(data, short):
        left = (_least(_placed(piece, _FINE), _SHORT) & _LOW).astype(np.int64)
        serving.append(start + left)
        borders_l.append(start + left[np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))])
    border = np.unique(np.concatenate(borders_l))
    served = np.concatenate(serving)[: len(region) - width + 1]
    back = served - np.arange(len(served))
    fewest, most = np.full(len(border), -1), np.full(len(border), -1)
    edge = np.flatnonzero(np.concatenate(([True], served[1:] != served[:-1])))
    at = np.searchsorted(border, served[edge])
    most[at] = back[edge]
    fewest[at] = back[np.append(edge[1:], len(served)) - 1]
    digest = xxhash.xxh3_64_intdigest
    cut = border.tolist()
    symbols = [digest(region[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    stop = np.minimum(np.searchsorted(border, border + _REACH), np.arange(len(border)) + _SYMBOLS)
    keep = (most >= 0) & (stop < len(border))  # always so for borders that serve a window
    prefix = [digest(region[a : cut[s]]) if k else 0 for a, s, k in zip(cut, stop.tolist(), keep.tolist(), strict=True)]
    fewest[~keep], most[~keep] = -1, -1
    return border, fewest, most, symbols, prefix


_REGION = "sid long, doc_id long, th long, start int, body binary, border array<int>, fewest array<int>, most array<int>, s array<long>, prefix array<long>, digest binary"


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _regions(docs: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """One row per region of candidate windows with its bytes, borders and symbols."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in _REGION.split(", ")]
        schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 3, *[pa.list_(pa.int64())] * 2, pa.binary()), strict=True)))
        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                rows = []
                for doc_id, th, body, runs in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "body", "runs")), strict=True):
                    for first, stop in _joined([(r["first"], r["last"] + 1) for r in runs]):
                        region = body[first : stop - 1 + width]
                        border, fewest, most, symbols, prefix = _phrases(region, width)
                        rows.append((sid, doc_id, th, first, region, border, fewest, most, _signed(symbols), _signed(prefix), xxhash.xxh3_128_digest(region)))
                        sid += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    both = docs.join(candidates.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "runs"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    return stored(both.select("doc_id", "th", "body", "runs").mapInArrow(run, _REGION), "regions")


def _kinds(regions: DataFrame) -> DataFrame:
    """(sid, times): one region of each kind, and how many there are of it."""
    return stored(regions.groupBy("digest").agg(F.min("sid").alias("sid"), F.count("*").alias("times")), "kinds")


def _adjacent(regions: DataFrame, ranks: DataFrame) -> DataFrame:
    """(sid, borders): the serving borders whose suffix shares its prefix with an adjacent suffix."""
    place = lambda names: F.posexplode(F.arrays_zip(*names)).alias("at", "x")
    rows = regions.select("sid", "border", "most", "prefix").join(ranks, "sid").select("sid", place(["border", "most", "prefix", "ranks"]))
    rows = rows.filter("x.most >= 0").select(F.col("x.ranks").alias("rank"), "sid", F.col("at").cast("int").alias("at"), F.col("x.prefix").alias("prefix"))
    schema = "sid long, at int, prefix long, part long, place long, like boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before, held = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            prefix = table.column("prefix").to_numpy()
            same = prefix[1:] == prefix[:-1]
            like = np.concatenate(([before == prefix[0]], same)) | np.concatenate((same, [False]))
            n = table.num_rows - 1  # the last one waits for its neighbour
            out = table.slice(0, n)
            yield pa.RecordBatch.from_arrays(
                [out.column("sid"), out.column("at"), out.column("prefix"), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(place, place + n)), pa.array(like[:n])],
                [c.split()[0] for c in schema.split(", ")])
            place += n
            before = prefix[n - 1] if n else before
            held = table.slice(n)
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [held.column("sid"), held.column("at"), held.column("prefix"), pa.array([part], pa.int64()), pa.array([place], pa.int64()), pa.array([bool(before == held.column("prefix")[0].as_py())])],
                [c.split()[0] for c in schema.split(", ")])

    order = stored(rows, "order")
    rows = order.repartitionByRange("rank", "sid", "at").sortWithinPartitions("rank", "sid", "at")
    rows = stored(rows.mapInArrow(run, schema), "adjacent")
    discard(order)
    # neighbours across parts: one row per part
    ends = rows.groupBy("part").agg(F.min_by("prefix", "place").alias("first"), F.max_by("prefix", "place").alias("last"), F.max("place").alias("top"))
    parts = Window.orderBy("part")
    ends = ends.select("part", "top", (F.col("first") == F.lag("last").over(parts)).alias("up"), (F.col("last") == F.lead("first").over(parts)).alias("down"))
    both = rows.join(F.broadcast(ends), "part")
    like = F.col("like") | ((F.col("place") == 0) & F.coalesce("up", F.lit(False))) | ((F.col("place") == F.col("top")) & F.coalesce("down", F.lit(False)))
    found = stored(both.filter(like).groupBy("sid").agg(F.array_sort(F.collect_set("at")).alias("found")), "found")
    discard(rows)
    return found


def _blocks(regions: DataFrame, adjacent: DataFrame, width: int) -> DataFrame:
    """The block of windows that each border found serves, fewest to most bytes before it, with a digest of its bytes and one
    of its core, the bytes after the border that every window it can serve covers."""
    schema = "doc_id long, th long, border int, fewest int, most int, core long, digest binary, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, "body", 4 << 20):
                rows: list[tuple] = []
                columns = ("doc_id", "th", "start", "body", "border", "fewest", "most", "found", "times")
                for doc_id, th, start, body, border, fewest, most, found, times in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
                    for i in found:
                        a, z = border[i] - most[i], border[i] - fewest[i]
                        block = digest(body[a : z + width] + b"%d %d" % (fewest[i], most[i]))
                        core = xxhash.xxh3_64_intdigest(body[border[i] : border[i] + width - _SHORT + 1]) - (1 << 63)
                        rows.append((doc_id, th, start + border[i], fewest[i], most[i], core, block, times))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, (pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.binary(), pa.int64()), strict=True)],
                    ["doc_id", "th", "border", "fewest", "most", "core", "digest", "times"])

    return regions.join(adjacent, "sid").select("doc_id", "th", "start", "body", "border", "fewest", "most", "found", "times").mapInArrow(run, schema)


def _contested(items: DataFrame) -> DataFrame:
    """Of items (core, digest, n, x): the kinds (digest, n, x) of every core that has a lone item and another kind."""
    kinds = items.groupBy("core", "digest").agg(F.sum("n").alias("n"), F.min("x").alias("x"))
    cores = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1").select("core")
    return kinds.join(cores, "core", "left_semi").select("digest", "n", "x.*")


def _in_texts(regions: DataFrame, picked: DataFrame, width: int, near: str, far: str, schema: str, made: Callable[[bytes, dict], Iterator[tuple]]) -> DataFrame:
    """Rows made of the bytes of each picked item; `made` gets the region and the item, with places inside the region.

    near, far: fields with the item's least and greatest distance back. Regions can overlap in bytes, but just one holds
    all windows of an item.
    """
    fields = [c for c in picked.columns if c not in ("doc_id", "th")]
    by_text = picked.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(F.struct(*fields)).alias("picked"))
    texts = regions.select("doc_id", "th", F.col("start").alias("from"), "body").join(by_text, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    inside = F.filter("picked", lambda x: (x["border"] - x[far] >= F.col("from")) & (x["border"] - x[near] + width <= F.col("from") + F.length("body")))
    texts = texts.select("from", "body", inside.alias("picked")).filter(F.size("picked") > 0)
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    out = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", 1 << 20):
                rows = [
                    row
                    for start, body, picked in zip(*(part.column(c).to_pylist() for c in ("from", "body", "picked")), strict=True)
                    for x in picked for row in made(body, x | {"border": x["border"] - start})
                ]
                columns = zip(*rows, strict=True) if rows else [()] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return texts.mapInArrow(run, schema)


def _alone(regions: DataFrame, blocks: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two stored steps, and (digest, hits): repeated windows inside blocks that stand alone, as distances back from the block's border.

    The windows of a block are known by their distance from the border, which equal windows share. A block that stands
    alone is compared with one block for each other digest of its core: first in cells of _CELL windows, each with a core
    of its own, then, in cells that stand alone with others of their core, window by window.
    """
    sha = xxhash.xxh3_128_digest

    def cells(body: bytes, x: dict) -> Iterator[tuple]:
        a = x["border"]
        for k in range(x["fewest"] // _CELL, x["most"] // _CELL + 1):
            lo, hi = max(x["fewest"], k * _CELL), min(x["most"], k * _CELL + _CELL - 1)
            core = sha(body[max(0, a - k * _CELL) : a - k * _CELL - _CELL + 1 + width] + b"%d" % k)
            yield x["digest"], x["n"], lo, hi, core, sha(body[a - hi : a - lo + width] + b"%d %d" % (lo, hi)), x["at_doc"], x["at_th"], x["at_border"]

    def windows(body: bytes, x: dict) -> Iterator[tuple]:
        for back in range(x["lo"], x["hi"] + 1):
            yield x["digest"], back, x["n"], sha(body[x["border"] - back : x["border"] - back + width])

    items = blocks.select("core", "digest", F.col("times").alias("n"), F.struct("doc_id", "th", "border", "fewest", "most").alias("x"))
    picked = _contested(items).withColumns({"at_doc": F.col("doc_id"), "at_th": F.col("th"), "at_border": F.col("border")})
    made = stored(_in_texts(regions, picked, width, "fewest", "most", "block binary, n long, lo int, hi int, core binary, digest binary, doc_id long, th long, border int", cells), "cells")
    rows = made.select("core", "digest", "n", F.struct("doc_id", "th", "border", "lo", "hi").alias("x"))
    seen = stored(_in_texts(regions, _contested(rows), width, "lo", "hi", "digest binary, back int, n long, window binary", windows), "window")
    again = seen.groupBy("window").agg(F.sum("n").alias("total")).filter("total > 1").select("window")
    single = seen.filter("n = 1").join(again, "window", "left_semi").select("digest", F.array("back").alias("backs"))
    whole = made.groupBy("digest").agg(F.sum("n").alias("total")).filter("total > 1").select("digest")
    lone = made.filter("n = 1").select("block", "digest", "lo", "hi")
    found = lone.join(whole, "digest", "left_semi").select("block", F.sequence("lo", "hi").alias("backs"))
    found = found.union(lone.join(single, "digest").select("block", "backs"))
    return made, seen, found.groupBy(F.col("block").alias("digest")).agg(F.array_distinct(F.flatten(F.collect_list("backs"))).alias("hits"))  # up to the windows of a block


def _spans(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, spans): repeated spans [start, stop) of each text that has some; they may overlap."""
    windows, candidates = _candidates(docs, width)
    regions = _regions(docs, candidates, width)
    discard(windows)
    kinds = _kinds(regions)
    # equal regions are repeated as a whole; one of each kind is compared with the others
    copies = regions.join(kinds.filter("times > 1").select("digest"), "digest").select("doc_id", "th", "start", (F.col("start") + F.length("body")).alias("stop"))
    one = kinds.select("sid", "times")
    ranks = suffix_ranks(regions.select("sid", "s").join(one.select("sid"), "sid", "left_semi"), _SYMBOLS)
    adjacent = _adjacent(regions, ranks)
    discard(ranks)
    blocks = stored(_blocks(regions, adjacent.join(one, "sid"), width), "blocks")
    discard(adjacent)
    many = blocks.groupBy("digest").agg(F.sum("times").alias("n")).filter("n > 1").select("digest")
    rest = blocks.filter("times = 1")
    whole = rest.join(many, "digest", "left_semi").select("doc_id", "th", (F.col("border") - F.col("most")).alias("start"), (F.col("border") - F.col("fewest") + width).alias("stop"))
    cells, seen, hits = _alone(regions, blocks, width)
    alone = rest.join(hits, "digest").select("doc_id", "th", "border", F.explode("hits").alias("back"))
    alone = alone.select("doc_id", "th", (F.col("border") - F.col("back")).alias("start"), (F.col("border") - F.col("back") + width).alias("stop"))
    spans = stored(copies.union(whole).union(alone).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    discard(regions, kinds, blocks, cells, seen)
    return spans


def _mended(kept: bytes) -> str | None:
    """The text without the bytes of broken characters; None: there are none, and kept is the text."""
    try:
        kept.decode()
    except UnicodeDecodeError:
        return kept.decode(errors="ignore")
    return None


def remove_repeats(docs: DataFrame, width: int = 400, doc_id: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, kept_text) of every row of `docs`.

    Each byte covered by a string of `width` bytes that also starts elsewhere, in the same text or another, is removed;
    strings are judged on the input. Null texts are empty; texts shorter than `width` stay whole; repeated rows are texts
    of their own, so a repeated long text goes entirely; null doc_ids are allowed; further columns are not read but for
    the one named by `carry`, which is passed on; no rows give no rows. `kept` can break a character that a span cuts
    through; kept_text leaves the bytes of such a character out. width: 400 or more.
    """
    if width < 400:
        raise ValueError("the shared phrases are guaranteed for 400 bytes or more")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    extra = [F.col(carry).alias("carry")] if carry else []
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("body"), *extra)
    found = _spans(docs.select("doc_id", "th", "body"), width).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans")
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left").drop("th", "_d", "_t")
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "mended": pa.string()}
    passed = ["doc_id", *(["carry"] if carry else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                rows = []
                for body, spans in zip(part.column("body").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    cut = _joined([(s["start"], s["stop"]) for s in spans or ()])
                    edges = [0, *(x for span in cut for x in span), len(body)]
                    kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(body), len(body) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept, _mended(kept)))
                made = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *made], [*passed, *kinds])

    schema = T.StructType([both.schema[c] for c in passed] + [T.StructField(n, _TYPES[str(t)]) for n, t in kinds.items()])
    out = both.mapInArrow(run, schema).withColumn("kept_text", F.coalesce("mended", F.col("kept").cast("string"))).drop("mended")
    return out.withColumnRenamed("carry", carry) if carry else out


_CODE = 8  # bytes that stand for a word


def _coded(docs: DataFrame) -> DataFrame:
    """(doc_id, th, body): every word of the texts as the 8 bytes of its XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for part in slices(batch, "body"):
                if len(known) > 50_000:
                    known = {}
                made = []
                for body in part.column("body").to_pylist():
                    words = body.split()  # at ASCII white space, as bytes
                    for w in set(words):
                        if w not in known:
                            known[w] = xxhash.xxh64_digest(w)
                    made.append(b"".join([known[w] for w in words]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(made, pa.binary())], ["doc_id", "th", "body"])

    return docs.mapInArrow(run, "doc_id long, th long, body binary")


def word_spans(spans: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Words [first, stop) of coded spans: of each, its windows that start with a word."""
    found = []
    for start, stop in spans:
        first, last = -(-start // _CODE), (stop - width) // _CODE
        if first <= last:
            found.append((first, last + width // _CODE))
    return _joined(found)


def remove_passages(docs: DataFrame, words: int = 50, doc_id: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row of `docs`: each word in a run of `words` equal words that also starts
    elsewhere, in the same text or another, is removed.

    Words are separated by ASCII white space, which need not be equal. They stand as codes of 8 bytes, and repeated runs
    are the repeated windows of 8 * words bytes that start with a code (see the module's text; two words of one code are
    taken as equal). White space around a removed run stays. Null texts are empty; shorter texts stay as they are;
    repeated rows are texts of their own; null doc_ids are allowed; further columns are not read but for `carry`, which is
    passed on; no rows give no rows. words: 50 or more.
    """
    width = _CODE * words
    if width < 400:
        raise ValueError("the shared phrases are guaranteed for 50 words or more")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    extra = [F.col(carry).alias("carry")] if carry else []
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("body"), *extra)
    found = _spans(_coded(docs.select("doc_id", "th", "body")), width).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans")
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left").drop("th", "_d", "_t")
    passed = ["doc_id", *(["carry"] if carry else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                rows = []
                for body, spans in zip(part.column("body").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    cut = word_spans([(s["start"], s["stop"]) for s in spans or ()], width)
                    at = [m.span() for m in _WORD.finditer(body)] if cut else ()
                    edges = [0, *(x for first, stop in cut for x in (at[first][0], at[stop - 1][1])), len(body)]
                    kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(at) if cut else len(body.split()), sum(b - a for a, b in cut), kept.decode()))
                made = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *made], [*passed, "n_words", "n_removed", "kept_text"])

    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    out = both.mapInArrow(run, T.StructType([both.schema[c] for c in passed] + added))
    return out.withColumnRenamed("carry", carry) if carry else out


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every document, and the digest of the rest."""
    return remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text")).drop("kept", "kept_text")
