"""Toxicity by a weighted lexicon (operator 4).

Texts are folded (case, look-alike letters of other scripts, digits and signs that stand for letters inside words) and
matched in one pass by an Aho-Corasick automaton of word beginnings with weights. A hit that lies in an exception phrase
does not count. The weights of the hits, normalised by the length of the text, give a score from 0 to 1.

Lexicon, exception phrases and the score's curve are learned from at most `most_rows` labelled rows; the labels of rows
whose crc32(doc_id as text) is divisible by `folds` are never read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import read, slices

#: Fixed: letters of other scripts that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
#: Fixed: signs that stand for letters in a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_FOLD = str.maketrans(LOOK_ALIKE | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | dict.fromkeys("­​‌‍⁠﻿"))
_SUB = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_@$]*[@$]?[^\W_@$]+(?:[@$]+[^\W_@$]+)*")
_LETTER = re.compile(r"[^\W\d_]")


def folded(text: str | None) -> list[str]:
    """Folded words of a text."""
    words = _WORD.findall((text or "").lower().translate(_FOLD))
    return [w if w.isalpha() or not _LETTER.search(w) else w.translate(_SUB) for w in words]


def beginnings(words: set[str], shortest: int = 4, longest: int = 12) -> set[str]:
    return {w[:n] for w in words for n in range(min(shortest, len(w)), min(longest, len(w)) + 1)}


@dataclass(frozen=True)
class Lexicon:
    weights: tuple[tuple[str, float], ...]  # word beginning -> weight
    exceptions: tuple[str, ...]  # phrases of two folded words
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)


@functools.lru_cache(maxsize=4)
def _automaton(lexicon: Lexicon):
    import ahocorasick

    a = ahocorasick.Automaton()
    for pattern, weight in lexicon.weights:
        a.add_word(f" {pattern}", (pattern, weight))
    for phrase in lexicon.exceptions:
        a.add_word(f" {phrase} ", (phrase, None))
    a.make_automaton()
    return a if len(a) else None


def hits(words: list[str], lexicon: Lexicon) -> list[tuple[str, float]]:
    """(pattern, weight) of every word that begins with a pattern, the heaviest one, unless an exception phrase holds it."""
    automaton = _automaton(lexicon)
    if not words or automaton is None:
        return []
    best: dict[int, tuple[str, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (pattern, weight) in automaton.iter(f" {' '.join(words)} "):
        if weight is None:
            excused.append((end - len(pattern) - 1, end))
        elif weight > best.get(end - len(pattern), ("", 0.0))[1]:
            best[end - len(pattern)] = (pattern, weight)
    return [hit for at, hit in best.items() if not any(s <= at < e for s, e in excused)]


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float]:
    """(log of the weight per thousand words, log of the whole weight)."""
    words = folded(text)
    total = sum(weight for _, weight in hits(words, lexicon))
    return float(np.log1p(1000 * total / (len(words) + 20))), float(np.log1p(total))


def _sample(docs: DataFrame, labels: DataFrame, most_rows: int, folds: int) -> DataFrame:
    """(text, toxic) of at most about most_rows labelled rows outside the held-out fold, chosen by a hash of the id."""
    usable = labels.filter((fold("doc_id", folds) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    share = int(min(1.0, most_rows / max(n, 1)) * (1 << 20))
    usable = usable.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < share)
    return docs.join(F.broadcast(usable), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))  # most_rows ids


def _count(rows: DataFrame, schema: str, count) -> DataFrame:
    """Counters of a function over the batches of (text, toxic), summed by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = count(zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["key", "toxic", "n"])

    return rows.mapInArrow(run, schema).groupBy("key", "toxic").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, folds: int = 5, least_docs: int = 5, least_odds: float = 6.0) -> Lexicon:
    """Lexicon from labelled rows. A word beginning gets the log-odds of toxic against clean documents as its weight.

    It is taken in if at least least_docs toxic documents hold it and its odds are least_odds or more, and if no shorter
    beginning does as well. A phrase of two words around a hit is an exception if clean documents hold it, toxic ones
    hardly ever. All tables here are bounded by most_rows.
    """
    rows = _sample(docs, labels, most_rows, folds)
    schema = "key string, toxic int, n long"

    def of_toxic(pairs) -> Counter:
        found: Counter = Counter()
        for text, toxic in pairs:
            found[None, toxic] += 1
            if toxic:
                found.update((b, 1) for b in beginnings(set(folded(text))))
        return found

    first = {(r.key, r.toxic): r.n for r in _count(rows, schema, of_toxic).filter((F.col("n") >= least_docs) | F.col("key").isNull()).collect()}
    n_toxic, n_clean = first.get((None, 1), 0), first.get((None, 0), 0)
    candidates = frozenset(k for k, toxic in first if k is not None)
    if not candidates or not n_clean:
        return Lexicon((), ())

    def of_clean(pairs) -> Counter:
        found: Counter = Counter()
        for text, toxic in pairs:
            if not toxic:
                found.update((b, 0) for b in beginnings(set(folded(text))) & candidates)
        return found

    clean = {r.key: r.n for r in _count(rows, schema, of_clean).collect()}
    ratio = lambda t, c: (t + 0.5) / (n_toxic + 1) * (n_clean + 1) / (c + 0.5)
    odds = {b: ratio(first[b, 1], clean.get(b, 0)) for b in candidates}
    chosen = {b: (float(np.log(o)), first[b, 1]) for b, o in odds.items() if o >= least_odds}
    kept = {b: w for b, (w, n) in chosen.items() if not any(b[:i] in chosen and chosen[b[:i]][0] >= w - 0.7 for i in range(1, len(b)))}
    lexicon = Lexicon(tuple(sorted(kept.items())), ())

    def around(pairs) -> Counter:
        found: Counter = Counter()
        for text, toxic in pairs:
            words = folded(text)
            hit = [any(w[:n] in kept for n in range(1, 13)) for w in words]
            found.update({(f"{a} {b}", int(bool(toxic))) for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y})
        return found

    near: dict[str, list[int]] = {}
    for r in _count(rows, schema, around).filter(F.col("n") >= 3).collect():
        near.setdefault(r.key, [0, 0])[r.toxic] = r.n
    exceptions = tuple(sorted(p for p, (c, t) in near.items() if c >= 3 and c * n_toxic >= 20 * max(t, 0.1) * n_clean))
    lexicon = Lexicon(lexicon.weights, exceptions)
    if exceptions:  # the weights without the hits that are excused now

        def left(pairs) -> Counter:
            found: Counter = Counter()
            for text, toxic in pairs:
                found.update((p, int(bool(toxic))) for p in {p for p, _ in hits(folded(text), lexicon)})
            return found

        seen = {(r.key, r.toxic): r.n for r in _count(rows, schema, left).collect()}
        again = {p: ratio(seen.get((p, 1), 0), seen.get((p, 0), 0)) for p, _ in lexicon.weights if seen.get((p, 1), 0) >= least_docs}
        lexicon = Lexicon(tuple(sorted((p, float(np.log(o))) for p, o in again.items() if o >= least_odds)), exceptions)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([features(t, lexicon) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), batch.column("toxic")], ["rate", "whole", "toxic"])

    table = rows.mapInArrow(measured, "rate double, whole double, toxic int").toPandas()  # most_rows rows
    return Lexicon(lexicon.weights, lexicon.exceptions, _fit(table[["rate", "whole"]].to_numpy(), (table["toxic"] > 0).to_numpy(np.float64)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps, rows in a fixed order."""
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    x, y = np.column_stack((np.ones(len(x)), x))[order], y[order]
    b = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([0.01, 1, 1])
        b = b + np.linalg.solve(h, x.T @ (y - p) - ridge * np.array([0.01, 1, 1]) * b)
    return tuple(map(float, np.round(b, 9)))


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted) of every row. Null and empty texts get the score of no hit; texts of any length are
    read whole; repeated rows score alike; no rows give no rows; further columns are not read. An empty lexicon scores
    every text 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = np.array(lexicon.curve)
        for batch in batches:
            for part in slices(batch, "text"):
                f = np.array([(1.0, *features(t, lexicon)) for t in part.column("text").to_pylist()]).reshape(-1, 3)
                score = 1 / (1 + np.exp(-np.clip(f @ b, -30, 30))) if lexicon.weights else np.zeros(len(f))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a lexicon learned outside the held-out fold."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    lexicon = learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    out = toxicity(docs, lexicon)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
