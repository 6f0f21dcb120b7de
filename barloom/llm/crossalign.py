"""Alignment of two tokenizers' tokens over the same bytes (operator 13).

Tokens of A (byte-level BPE) and B (BPE with byte fallback) tile the bytes of " " + text. Places where tokens of both end
cut them into groups; within a group every A token is linked with every B token.

A stretch of bytes gives a *fragment*: the tokens that start in it, as an open prefix (up to the first shared end), closed
groups, and an open suffix (behind the last shared end). Fragments of neighbouring stretches compose: the suffix of one and
the prefix of the next are cut again, which may close groups across the border. Composition is associative, so very long
documents are dealt out as byte ranges over tasks and their fragments reduced by a tree, a few neighbours at a time. A short
document is one stretch.

Both tokenizers never merge across a single space between visible characters, so texts are tokenized piece by piece
between such spaces, and every distinct piece once per batch of documents. A byte range gets the pieces it overlaps, so its
tokens are those of the whole text; a piece longer than a range belongs to the range it starts in.

The links of a block of documents (about `block_bytes` of text) are counted there; only the block's distinct id pairs are
shuffled for the corpus-wide counts, and the counts it needs come back to it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import buffers, discard, read, slices, stored
from barloom.llm.tokens import Encoder, _byte_table, cut_pieces, default_path

_SHIFT = 15  # an id pair is a << 15 | b; vocabularies B of up to 32,768 entries
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())


def _flat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes on end, offsets) of byte strings."""
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in strings])))


def _gather(values: np.ndarray, at: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the lists `use` on end, offsets of these)."""
    start, size = at[use], at[use + 1] - at[use]
    total = np.concatenate(([0], np.cumsum(size)))
    return values[np.repeat(start - total[:-1], size) + np.arange(total[-1])], total


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class Aligner:
    """Tokens of pieces (strings that start with a space) under both vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a, 100_000)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in _byte_table().items()}
        names = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.tokenizer.get_vocab_size())]
        bytes_a = [bytes(back[c] for c in name) if all(c in back for c in name) else name.encode() for name in names]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(names) > 1 << _SHIFT or any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("vocabulary B must have up to 32,768 entries, none with a space behind another character")
        bytes_b = [bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.bytes_a, self.bytes_b = _flat(bytes_a), _flat(bytes_b)
        self.len_a, self.len_b = np.diff(self.bytes_a[1]), np.diff(self.bytes_b[1])
        # the text of an id, with each separator that can follow it
        most = max(len(bytes_a), len(bytes_b))
        self.names = [_flat([b"%d%c" % (i, sep) for i in range(most)]) for sep in b",|;"]

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """(ids of A on end, offsets of each piece, those of B, whether both give the piece's bytes back)."""
        a, at_a = self.a.encode(pa.array(pieces, pa.string()))
        found = self.b.encode([p[1:] for p in pieces], num_threads=1)
        at_b = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        b = np.fromiter(chain.from_iterable(found), np.int64, int(at_b[-1]))
        a = a.astype(np.int64)
        raw = [p.encode() for p in pieces]
        same = self._gives_back(a, at_a, self.bytes_a, raw) & self._gives_back(b, at_b, self.bytes_b, raw)
        return a, at_a, b, at_b, same

    @staticmethod
    def _gives_back(ids: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray], raw: list[bytes]) -> np.ndarray:
        made, ends = _gather(*table, ids)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        like = np.diff(ends[at]) == size
        if not like.all():  # keep the places of the others in step
            made = made[np.repeat(like, np.diff(ends[at]))]
        text = np.frombuffer(b"".join([x for x, ok in zip(raw, like.tolist(), strict=True) if ok]), np.uint8)
        of = np.repeat(np.flatnonzero(like), size[like])
        like[of[made != text]] = False
        return like

    def groups(self, a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(groups of each piece, id pairs of all links on end, links of each piece, text of each piece's groups) of pieces
        whose tokens give the same bytes."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)  # every token has a byte at least
        last_a, last_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)  # of each group
        size_a, size_b = (np.diff(np.append(-1, x)) for x in (last_a, last_b))
        links = size_a * size_b
        k = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)  # number of a link in its group
        wide = np.repeat(size_b, links)
        codes = a[np.repeat(last_a - size_a + 1, links) + k // wide] << _SHIFT | b[np.repeat(last_b - size_b + 1, links) + k % wide]
        of = np.searchsorted(at_a, last_a, side="right") - 1  # the piece of a group
        pieces = len(at_a) - 1
        # the text: A's ids of a group, then B's; the separator depends on what follows
        n = len(a) + len(b)
        group_a, group_b = (np.repeat(np.arange(len(ends)), x) for x in (size_a, size_b))
        place_a = np.arange(len(a)) + np.concatenate(([0], np.cumsum(size_b)))[group_a]
        place_b = np.arange(len(b)) + np.cumsum(size_a)[group_b]
        ids, sep = np.empty(n, np.int64), np.zeros(n, np.int64)
        ids[place_a], ids[place_b] = a, b
        sep[place_a[last_a]], sep[place_b[last_b]] = 1, 2
        table = np.concatenate([x for x, _ in self.names])
        shift = np.concatenate(([0], np.cumsum([len(x) for x, _ in self.names])))
        start = np.stack([x[:-1] + d for (_, x), d in zip(self.names, shift, strict=False)])[sep, ids]
        size = np.diff(self.names[0][1])[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        text = table[np.repeat(start - total[:-1], size) + np.arange(total[-1])].tobytes()
        edge = total[at_a + at_b].tolist()
        texts = [text[x : y - 1] for x, y in zip(edge[:-1], edge[1:], strict=True)]
        return np.bincount(of, minlength=pieces), codes, np.bincount(of, links, pieces).astype(np.int64), texts


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(path_a, path_b)


def _pieces(data: np.ndarray, cuts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct pieces of UTF-8 bytes cut at `cuts`, and the number of each piece in them."""
    data = np.ascontiguousarray(data)
    coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


# ---- documents of one stretch

_ROW = "block long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pieces array<int>, times array<long>, codes array<int>, sizes array<int>, pairs array<int>, docs array<int>"
_ROW_TYPES = pa.schema([
    ("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
    ("pieces", _INTS), ("times", _LONGS), ("codes", _INTS), ("sizes", _INTS), ("pairs", _INTS), ("docs", _INTS)])


def _row(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _ROW_TYPES], schema=_ROW_TYPES)


def _aligned(batch: pa.RecordBatch, block: int, tool: Aligner) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0, one for each document, with the pieces it holds, and one row of kind 1 for the block: the links of its
    distinct pieces, and its distinct id pairs with the number of documents that hold them."""
    data, at = buffers(batch.column("body"))
    n = batch.num_rows
    sums = np.zeros((n, 4), np.int64)
    digests = [""] * n
    pieces, codes, sizes, pairs, docs = (np.empty(0, np.int64),) * 5
    edge = np.zeros(n + 1, np.int64)
    if len(data):
        cuts = cut_pieces(data, at)
        words, index = _pieces(data, cuts)
        a, at_a, b, at_b, valid = tool.tokens(words)
        first = np.searchsorted(cuts, at)  # the pieces of a document; none if it is empty
        of = np.repeat(np.arange(n), np.diff(first))
        ok = np.bincount(of, ~valid[index], n) == 0
        keep = ok[of]
        words = np.flatnonzero(np.bincount(index[keep], minlength=len(words)))  # of documents with tokens
        number = np.zeros(len(valid), np.int64)
        number[words] = np.arange(len(words))
        pieces, of = number[index[keep]], of[keep]
        (a, at_a), (b, at_b) = _gather(a, at_a, words), _gather(b, at_b, words)
        groups, codes, sizes, texts = tool.groups(a, at_a, b, at_b)
        for c, size in enumerate((np.diff(at_a), np.diff(at_b), groups, sizes)):
            sums[:, c] = np.bincount(of, size[pieces], n)
        edge = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))
        order = pieces.tolist()
        for i, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            if y > x:
                digests[i] = hashlib.sha256(b";".join([texts[p] for p in order[x:y]])).hexdigest()
        held = _distinct(of * len(words) + pieces)
        links, link_at = _gather(codes, np.concatenate(([0], np.cumsum(sizes))), held % max(1, len(words)))
        each = _distinct(np.repeat(held // max(1, len(words)), np.diff(link_at)) << 31 | links)
        pairs, docs = np.unique(each & ((1 << 31) - 1), return_counts=True)
    yield _row(
        n, block=pa.array(np.full(n, block)), kind=pa.array(np.zeros(n, np.int32)), doc_id=batch.column("doc_id"),
        **{c: pa.array(sums[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        groups_sha256=pa.array(digests, pa.string()), pieces=_lists(pieces, edge, pa.int32()))
    one = {c: _lists(x, np.array([0, len(x)]), pa.int32()) for c, x in (("codes", codes), ("sizes", sizes), ("pairs", pairs), ("docs", docs))}
    yield _row(1, block=pa.array([block], pa.int64()), kind=pa.array([1], pa.int32()), **one)


def _short(docs: DataFrame, path_a: str, path_b: str, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tool = TaskContext.get().partitionId() << 32, aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch, "body", block_bytes):
                yield from _aligned(part, block, tool)
                block += 1

    return docs.mapInArrow(run, _ROW)


# ---- very long documents

_OPEN = [f"{end}_{x}" for end in ("pre", "suf") for x in ("a", "a_end", "b", "b_end")]
_FRAGMENT = pa.schema([
    ("key", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("valid", pa.bool_()), ("cut", pa.bool_()),
    *[(c, _LONGS) for c in _OPEN], ("groups", pa.binary()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("pairs", _LONGS), ("times", _LONGS)])
_FRAGMENT_SQL = ", ".join(["key long", "part int", "doc_id long", "valid boolean", "cut boolean", *[f"{c} array<long>" for c in _OPEN], "groups binary",
                           "n_a long", "n_b long", "n_groups long", "n_links long", "pairs array<long>", "times array<long>"])


def fragment(a: np.ndarray, end_a: np.ndarray, b: np.ndarray, end_b: np.ndarray, start: tuple[int, int]) -> dict:
    """The fragment of neighbouring tokens (ids, places where they end); start: where the first of A and of B starts."""
    ends = np.intersect1d(np.append(start[0], end_a) if len(a) else [], np.append(start[1], end_b) if len(b) else [])
    if not len(ends):
        empty = np.empty(0, np.int64)
        opened = dict(zip(_OPEN, (a, end_a, b, end_b, empty, empty, empty, empty), strict=True))
        return {"cut": False, **opened, "groups": b"", "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "pairs": empty, "times": empty}
    at_a, at_b = np.searchsorted(end_a, ends, side="right"), np.searchsorted(end_b, ends, side="right")
    made, links = [], []
    ids_a, ids_b = a.tolist(), b.tolist()
    for p, q, r, s in zip(at_a[:-1].tolist(), at_a[1:].tolist(), at_b[:-1].tolist(), at_b[1:].tolist(), strict=True):
        made.append(f"{','.join(map(str, ids_a[p:q]))}|{','.join(map(str, ids_b[r:s]))}")
        links.append((a[p:q, None] << _SHIFT | b[None, r:s]).ravel())
    pairs, times = np.unique(np.concatenate(links) if links else np.empty(0, np.int64), return_counts=True)
    opened = (a[: at_a[0]], end_a[: at_a[0]], b[: at_b[0]], end_b[: at_b[0]], a[at_a[-1] :], end_a[at_a[-1] :], b[at_b[-1] :], end_b[at_b[-1] :])
    return {"cut": True, **dict(zip(_OPEN, opened, strict=True)), "groups": ";".join(made).encode(), "n_a": int(at_a[-1] - at_a[0]), "n_b": int(at_b[-1] - at_b[0]),
            "n_groups": len(made), "n_links": int(times.sum()), "pairs": pairs, "times": times}


def compose(f: dict, g: dict, len_a: np.ndarray, len_b: np.ndarray) -> dict:
    """The fragment of two neighbouring stretches. Associative."""
    of = "suf" if f["cut"] else "pre"
    a, end_a, b, end_b = (np.concatenate((f[f"{of}_{x}"], g[f"pre_{x}"])).astype(np.int64) for x in ("a", "a_end", "b", "b_end"))
    start = (int(end_a[0] - len_a[a[0]]) if len(a) else -1, int(end_b[0] - len_b[b[0]]) if len(b) else -1)
    m = fragment(a, end_a, b, end_b, start)
    out = {"cut": f["cut"] or m["cut"] or g["cut"]}
    first = f if f["cut"] else m
    last = g if g["cut"] else m
    if not m["cut"] and f["cut"]:  # nothing closes: what is open stays open behind f
        last = g if g["cut"] else {f"suf_{x}": m[f"pre_{x}"] for x in ("a", "a_end", "b", "b_end")}
    for x in ("a", "a_end", "b", "b_end"):
        out[f"pre_{x}"] = first[f"pre_{x}"]
        out[f"suf_{x}"] = last[f"suf_{x}"]
    parts = (f, m, g)
    out["groups"] = b";".join(p["groups"] for p in parts if p["n_groups"])
    out |= {c: sum(p[c] for p in parts) for c in ("n_a", "n_b", "n_groups", "n_links")}
    pairs, place = np.unique(np.concatenate([p["pairs"] for p in parts]).astype(np.int64), return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, place, np.concatenate([p["times"] for p in parts]).astype(np.int64))
    return out | {"pairs": pairs, "times": times}


def _ranges(body: bytes, range_bytes: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop, first byte, last byte needed) of the byte ranges of a text."""
    data = np.frombuffer(body, np.uint8)
    cuts = cut_pieces(data, np.array([0, len(data)]))
    border = np.append(np.arange(0, len(data), range_bytes), len(data))
    after = np.searchsorted(cuts, border)
    before = np.searchsorted(cuts, border, side="right") - 1
    giant = cuts[after] - cuts[before] > range_bytes  # the piece at a border is longer than a range: it is left whole
    border = np.unique(np.where(giant, cuts[after], border))
    for start, stop in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        yield start, stop, int(cuts[np.searchsorted(cuts, start, side="right") - 1]), int(cuts[np.searchsorted(cuts, stop)])


def _dealt(docs: DataFrame, range_bytes: int) -> DataFrame:
    """The byte ranges of long texts: (key of the document, part, doc_id, start, stop, body from byte `first` on)."""
    schema = "key long, part int, doc_id long, start long, stop long, first long, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body"), strict=True):
                body = body.as_py()
                for part, (start, stop, first, last) in enumerate(_ranges(body, range_bytes)):
                    row = (key, part, doc_id, start, stop, first, body[first:last])
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])
                key += 1

    return docs.mapInArrow(run, schema)


def _fragment_row(key: int, part: int, doc_id: int | None, valid: bool, made: dict) -> pa.RecordBatch:
    row = {"key": key, "part": part, "doc_id": doc_id, "valid": valid} | made
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _FRAGMENT], schema=_FRAGMENT)


def _fragments(ranges: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The fragment of every byte range: the tokens that start in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for batch in batches:
            for row in range(batch.num_rows):
                key, part, doc_id, start, stop, first = (batch.column(c)[row].as_py() for c in ("key", "part", "doc_id", "start", "stop", "first"))
                data = np.frombuffer(batch.column("body")[row].as_py(), np.uint8)
                words, index = _pieces(data, cut_pieces(data, np.array([0, len(data)])))
                a, at_a, b, at_b, same = tool.tokens(words)
                valid = bool(same.all())
                made = []
                for ids, at, size in ((a, at_a, tool.len_a), (b, at_b, tool.len_b)):
                    values = _gather(ids, at, index)[0]
                    end = first + np.cumsum(size[values])
                    begin = end - size[values]
                    own = (begin >= start) & (begin < stop)
                    made.append((values[own], end[own], int(begin[own][0]) if own.any() else -1))
                (a, end_a, from_a), (b, end_b, from_b) = made
                if not valid:
                    a = b = end_a = end_b = np.empty(0, np.int64)
                yield _fragment_row(key, part, doc_id, valid, fragment(a, end_a, b, end_b, (from_a, from_b)))

    return ranges.mapInArrow(run, _FRAGMENT_SQL)


def _reduced(fragments: DataFrame, path_a: str, path_b: str, fan: int) -> DataFrame:
    """Neighbouring fragments of a document composed, `fan` at a time, until one is left."""

    def run(table: pa.Table) -> pa.Table:
        tool = aligner(path_a, path_b)
        rows = [{c: np.array(v, np.int64) if isinstance(v, list) else v for c, v in x.items()} for x in table.sort_by("part").to_pylist()]
        valid = all(x["valid"] for x in rows)
        total = rows[0]
        for x in rows[1:] if valid else ():
            total = compose(total, x, tool.len_a, tool.len_b)
        total = {f.name: total[f.name] for f in _FRAGMENT if f.name in total}
        return pa.Table.from_batches([_fragment_row(rows[0]["key"], rows[0]["part"] // fan, rows[0]["doc_id"], valid, {k: v for k, v in total.items() if k not in ("key", "part", "doc_id", "valid")})])

    while fragments.filter("part > 0").limit(1).count():
        up = fragments.withColumn("up", F.floor(F.col("part") / fan).cast("int"))
        grouped = up.groupBy("key", "up").applyInArrow(lambda table: run(table.drop_columns(["up"])), _FRAGMENT_SQL)
        before, fragments = fragments, stored(grouped, "fragments")
        discard(before)
    return fragments


def _long(docs: DataFrame, path_a: str, path_b: str, range_bytes: int, fan: int) -> DataFrame:
    """The rows of `_aligned` for long documents, each a block of its own whose pieces are its id pairs."""
    ranges = stored(_dealt(docs, range_bytes), "ranges")
    rows = stored(_fragments(ranges.repartition(F.col("key"), F.col("part")), path_a, path_b), "fragments")
    discard(ranges)
    rows = _reduced(rows, path_a, path_b, fan)
    zero = lambda c: F.when(F.col("valid"), F.col(c)).otherwise(0)
    pairs = F.when(F.col("valid"), F.col("pairs")).otherwise(F.array().cast("array<long>"))
    block = (-1 - F.col("key")).alias("block")
    void = {c.split()[0]: F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _ROW.split(", ")}
    ones = F.transform(pairs, lambda _: F.lit(1)).alias("sizes")
    own = {"block": block, "kind": F.lit(0).alias("kind"), "doc_id": F.col("doc_id"), **{c: zero(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")},
           "groups_sha256": F.when(F.col("valid"), F.sha2("groups", 256)).otherwise("").alias("groups_sha256"),
           "pieces": F.transform(pairs, lambda _, i: i).cast("array<int>").alias("pieces"), "times": F.when(F.col("valid"), F.col("times")).otherwise(F.array().cast("array<long>")).alias("times")}
    of_block = {"block": block, "kind": F.lit(1).alias("kind"), "codes": pairs.cast("array<int>").alias("codes"), "sizes": ones, "pairs": pairs.cast("array<int>").alias("pairs"), "docs": ones.alias("docs")}
    return rows.select(*(void | own).values()).unionByName(rows.select(*(void | of_block).values()))


# ---- counts over all documents

_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(rows: DataFrame) -> DataFrame:
    """(block, pair, count, best): every id pair of a block with its number of documents corpus-wide, and whether that is the
    highest of its A id (of at most as many pairs as vocabulary B has entries)."""
    seen = rows.filter("kind = 1").select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("n"))
    totals = seen.groupBy("pair").agg(F.sum("n").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", _SHIFT)))
    totals = totals.withColumn("best", F.col("count") == top)
    return seen.select("block", "pair").join(totals, "pair").select("block", "pair", "count", "best")


def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = 4 << 20, range_bytes: int = 1 << 16, fan: int = 8) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs (doc_id, text).

    Texts that are null, empty or not given back by one of the tokenizers have no tokens: zeros and an empty string. Rows
    with the same or no doc_id are documents of their own. Further columns are not read; no rows give no rows. Memory: a
    block of documents, or one document with its distinct pairs.
    """
    text = F.coalesce("text", F.lit(""))
    body = F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(" "), text)).cast("binary").alias("body")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body)
    long = docs.filter(F.length("body") > range_bytes)
    rows = _short(docs.filter(F.length("body") <= range_bytes), path_a, path_b, block_bytes)
    rows = stored(rows.unionByName(_long(long, path_a, path_b, range_bytes, fan)), "aligned")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.select(["pair", "count", "best"]).sort_by("pair")
        pair, count, best = (known.column(c).to_numpy() for c in known.column_names)
        kind = left.column("kind").to_numpy()
        block = left.filter(pa.array(kind == 1))
        codes, sizes = (block.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("codes", "sizes"))
        place, edge = np.searchsorted(pair, codes), np.concatenate(([0], np.cumsum(sizes)))
        sums = []
        for values in (best.astype(np.int64), count):  # of every piece of the block
            run = np.concatenate(([0], np.cumsum(values[place]) if len(codes) else []))
            sums.append((run[edge[1:]] - run[edge[:-1]]).astype(np.int64))
        own = left.filter(pa.array(kind == 0))
        out = {c: own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        column, times = own.column("pieces").combine_chunks(), own.column("times").combine_chunks()
        pieces = column.flatten().to_numpy().astype(np.int64)
        weight = times.flatten().to_numpy() if len(times) and not times.null_count else np.ones(len(pieces), np.int64)
        at = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        for name, of_piece in zip(("n_best", "count_sum"), sums, strict=True):
            run = np.concatenate(([0], np.cumsum(of_piece[pieces] * weight) if len(pieces) else [])).astype(np.int64)
            out[name] = pa.array(run[at[1:]] - run[at[:-1]])
        return pa.table(out | {"groups_sha256": own.column("groups_sha256")})

    counted = _counted(rows)
    left = rows.drop("pairs", "docs").withColumnRenamed("block", "of")
    return left.groupBy("of").cogroup(counted.groupBy("block")).applyInArrow(run, _OUT)


def op13_crossalign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens under the two public vocabularies."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return align(docs, default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))
