"""Filter interaction audit against brute force: nulls, empty and long texts, repeated rows and ids, clashing columns."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from barloom.llm import filteraudit

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, labels):
    """rows (doc_id, text, lang) -> {(part, order, step): figures}."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    parts = {}
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": bool(set("#$%&*|") & set(t)), "E": i is not None and smallest[t] < i}
        parts.setdefault(lang or "", []).append((i, {f for f, x in fails.items() if x}))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part, docs in parts.items():
        share = dict.fromkeys("ABCDE", 0)
        for o in orders:
            for k, f in enumerate(o):
                before = set(o[:k])
                hit = [(i, x) for i, x in docs if f in x and not x & before]
                share[f] += len(hit)
                out[part, o, k + 1] = [
                    sum(not x & (before | {f}) for _, x in docs), len(hit), sum(f in x and bool(x & before) for _, x in docs),
                    sum(x == {f} for _, x in docs), sum(i in good for i, _ in hit), sum(i in toxic for i, _ in hit)]
        for o in orders:
            for k, f in enumerate(o):
                out[part, o, k + 1].append(share[f])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    cols = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in cols) for r in df.collect()}


def sample(n, seed):
    r = random.Random(seed)
    rows = [(1, None, None), (2, "", "en"), (3, "", ""), (4, "one # two", None), (None, "one # two", "en"), (None, None, None), (2, "", "en"), (4, "other", "fr"),
            (5, "ÀB " * 300, "fr"), (6, "\x0b\x85  x" * 90, "fr"), (7, "Long words " * 40_000, "en"), (8, "Long words " * 40_000, "fr")]
    for i in range(n):
        text = " ".join(f"w{r.randrange(r.choice([30, 500]))}{r.choice(['', '', 'A', '%'])}" for _ in range(r.choice([5, 190, 210, 260])))
        rows += [(100 + 3 * i, text, r.choice(["en", "fr", None]))] + [(1000 - i + 7 * k, text, "en") for k in range(r.choice([0, 0, 1, 3]))]
    return rows


def test_audit(spark):
    rows = sample(60, 1)
    docs = spark.createDataFrame([(*x, 1, 2, "y") for x in rows], "doc_id long, text string, lang string, h int, mask int, part string")
    labels = [(i, i % 2, i % 3 % 2) for i, *_ in rows if i is not None and i % 5] + [(100, 1, 0), (100, 0, 1), (103, None, None), (None, 1, 1)]
    labelled = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int, part int")
    assert found(filteraudit.audit(filteraudit.mask_counts(docs, labelled))) == brute(rows, labels)


def test_sketch_clears_only_unique_texts(spark):
    df = spark.range(40_000).select(F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(F.col("id"))).alias("h"))
    times = df.groupBy("h").agg(F.count("*").alias("n"))
    for cells in (1 << 15, 1 << 28):  # one crowded block, and as many as the rows ask for
        sketch, blocks = filteraudit.repeat_sketch(df, 40_000, most_cells=cells)
        left = filteraudit._possible(times, sketch.persist(), blocks)
        assert left.filter("n > 1").count() == times.filter("n > 1").count()
        if cells > 1 << 15:
            assert blocks > 10 and left.filter("n = 1").count() < 1000


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(filteraudit.mask_counts(docs, labels)).count() == 0
