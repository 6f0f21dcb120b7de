"""Suffix order of many strings by the difference-cover algorithm, distributed.

A string is an array of longs. The suffixes at places 1 and 2 modulo 3 are the sample: their triples are sorted and
named in order, the strings of names are ordered by the same algorithm, and the remaining suffixes are merged in by
comparing one or two symbols and the rank of the sampled suffix behind them. Equal suffixes share a rank. The recursion
ends when every name occurs once, when the names reach `depth` symbols, or when nothing is left to sample.

Every sort is a range sort of distinct triples or distinct merge keys, so copies are one row in it, however many there
are; ranks are the part and the place in it, which need no counting over all parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, stored

PAD = -(1 << 63)  # behind the end of a string
_PART = 36


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values on end, sizes) of a list column; null counts as empty."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _ahead(values: np.ndarray, sizes: np.ndarray, by: int, pad: int) -> np.ndarray:
    """values[i + by] inside each list, pad behind its end."""
    out = np.full(len(values), pad, np.int64)
    out[: max(0, len(values) - by)] = values[by:]
    out[_places(sizes) + by >= np.repeat(sizes, sizes)] = pad
    return out


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in schema.split(", ")])


def _triples(strings: DataFrame) -> DataFrame:
    schema = "sid long, i int, t0 long, t1 long, t2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, sizes = _flat(batch.column("s"))
            i = _places(sizes)
            at = np.flatnonzero(i % 3)
            sid = np.repeat(batch.column("sid").to_numpy(), sizes)
            yield _batch(schema, sid[at], i[at].astype(np.int32), s[at], _ahead(s, sizes, 1, PAD)[at], _ahead(s, sizes, 2, PAD)[at])

    return strings.mapInArrow(run, schema)


def _named(triples: DataFrame) -> DataFrame:
    """(t0, t1, t2, name) of the distinct triples, names in their order."""
    schema = "t0 long, t1 long, t2 long, name long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << _PART
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, "name"])
            at += batch.num_rows

    key = ("t0", "t1", "t2")
    distinct = triples.select(*key).distinct()
    return stored(distinct.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(run, schema), "names")


_KEY = ("s0", "s1", "s2", "res", "ra", "rb", "rc")
_KEY_TYPES = "s0 long, s1 long, s2 long, res int, ra long, rb long, rc long"


def _merge_keys(strings: DataFrame) -> DataFrame:
    """What each suffix is compared by: its triple, residue, own rank (sampled ones) and the ranks one and two ahead."""
    schema = "sid long, i int, " + _KEY_TYPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, sizes = _flat(batch.column("s"))
            i = _places(sizes)
            rank = np.full(len(s), -1, np.int64)
            start = np.repeat(np.cumsum(sizes) - sizes, 1)
            for res in (1, 2):
                r, n = _flat(batch.column(f"r{res}"))
                rank[np.repeat(start, n) + res + 3 * _places(n)] = r
            res = (i % 3).astype(np.int32)
            one, two = _ahead(rank, sizes, 1, -1), _ahead(rank, sizes, 2, -1)
            sid = np.repeat(batch.column("sid").to_numpy(), sizes)
            yield _batch(schema, sid, i.astype(np.int32), s, _ahead(s, sizes, 1, PAD), _ahead(s, sizes, 2, PAD), res,
                         np.where(res > 0, rank, -1), np.where(res == 2, -1, one), np.where(res == 1, -1, two))

    return strings.mapInArrow(run, schema)


def _merge(rest: list[tuple], sample: list[tuple], out: list[tuple], at: int) -> int:
    """Merge the suffixes of one triple. rest: (rb, rc, row) of residue 0; sample: (ra, res, rb, rc, row)."""
    rest.sort()
    sample.sort()
    i = j = 0
    while i < len(rest) or j < len(sample):
        if i == len(rest):
            less, more = False, True
        elif j == len(sample):
            less, more = True, False
        else:
            a, b = (rest[i][0], sample[j][2]) if sample[j][1] == 1 else (rest[i][1], sample[j][3])
            less, more = a < b, a > b
        if not more:  # the remaining suffix is next, alone or equal to the sampled one
            key = rest[i][0]
            while i < len(rest) and rest[i][0] == key:
                out.append((rest[i][2], at))
                i += 1
        if not less:
            key = sample[j][0]
            while j < len(sample) and sample[j][0] == key:
                out.append((sample[j][4], at))
                j += 1
        at += 1
    return at


def _merged(keys: DataFrame) -> DataFrame:
    """The distinct merge keys with their rank."""
    schema = _KEY_TYPES + ", rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << _PART
        held: pa.Table | None = None

        def ranked(table: pa.Table) -> pa.RecordBatch:
            nonlocal at
            c = {n: table.column(n).to_numpy() for n in _KEY}
            new = np.ones(len(c["s0"]), bool)
            new[1:] = (c["s0"][1:] != c["s0"][:-1]) | (c["s1"][1:] != c["s1"][:-1]) | (c["s2"][1:] != c["s2"][:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(new)))
            rank = np.empty(len(new), np.int64)
            lists = [c[n].tolist() for n in ("res", "ra", "rb", "rc")]
            start = 0
            for n in size.tolist():
                if n == 1:
                    rank[start] = at
                    at += 1
                else:
                    rest, sample = [], []
                    for row in range(start, start + n):
                        res, ra, rb, rc = (x[row] for x in lists)
                        if res:
                            sample.append((ra, res, rb, rc, row))
                        else:
                            rest.append((rb, rc, row))
                    out: list[tuple] = []
                    at = _merge(rest, sample, out, at)
                    for row, r in out:
                        rank[row] = r
                start += n
            return _batch(schema, *(c[n] for n in _KEY), rank)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            last = [table.column(n)[table.num_rows - 1].as_py() for n in _KEY[:3]]
            same = np.logical_and.reduce([table.column(n).to_numpy() == v for n, v in zip(_KEY[:3], last, strict=True)])
            cut = int(np.argmax(same))  # sorted: the last triple may go on
            if cut:
                yield ranked(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield ranked(held)

    distinct = keys.select(*_KEY).distinct()
    return stored(distinct.repartitionByRange(*_KEY[:3]).sortWithinPartitions(*_KEY[:3]).mapInArrow(run, schema), "merged")


def _lists(rows: DataFrame, by: str, place: str, value: str, name: str) -> DataFrame:
    """(by, name): the values of each string in order of their places; a string is bounded by its document."""
    ordered = F.array_sort(F.collect_list(F.struct(place, value)))
    return rows.groupBy(by).agg(F.transform(ordered, lambda x: x[value]).alias(name))


def suffix_ranks(strings: DataFrame, depth: int) -> DataFrame:
    """(sid, ranks array<long>) of strings (sid long, s array<long>): ranks ordered like the suffixes, equal for suffixes
    that agree in `depth` symbols at least. sid: distinct, 0 to 2**56."""
    triples = stored(_triples(strings), "triples")
    names = _named(triples)
    n, distinct = triples.count(), names.count()
    found = triples.join(names, ["t0", "t1", "t2"])
    sub = _lists(found.select((F.col("sid") * 2 + F.col("i") % 3 - 1).alias("sid"), "i", "name"), "sid", "i", "name", "s")
    if n and distinct < n and depth > 3:
        sub = stored(sub, "strings")
        discard(triples, names)
        ranks = suffix_ranks(sub, -(-depth // 3))
        discard(sub)
    else:
        ranks = sub.withColumnRenamed("s", "ranks")
    sample = ranks.groupBy(F.floor(F.col("sid") / 2).cast("long").alias("_sid")).agg(
        F.max(F.when(F.col("sid") % 2 == 0, F.col("ranks"))).alias("r1"), F.max(F.when(F.col("sid") % 2 == 1, F.col("ranks"))).alias("r2"))
    both = strings.join(sample, F.col("sid") == F.col("_sid"), "left").select("sid", "s", "r1", "r2")
    keys = stored(_merge_keys(both), "keys")
    if hasattr(ranks, "stored_at"):
        discard(ranks)
    else:
        discard(triples, names)
    merged = _merged(keys)
    ranked = keys.join(merged, list(_KEY)).select("sid", "i", "rank")
    out = stored(_lists(ranked, "sid", "i", "rank", "ranks"), "ranks")
    discard(keys, merged)
    return out
