"""Windows of many texts at once, and texts handed over once (operator 3)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import repeats
from barloom.llm.common import buffers


def test_windows_of_texts_on_end_are_those_of_each_text():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 256, 700, np.uint8).tobytes()
    texts = [b"", b"a" * 900, shared, b"x" * 399, rng.integers(97, 100, 5000, np.uint8).tobytes(), b"", shared + b"y" * 400, b"z" * 400, b"w"]
    texts += [rng.integers(97, 123, int(n), np.uint8).tobytes() for n in rng.integers(0, 6000, 30)] + [shared * 60]
    data, at = buffers(pa.array(texts, pa.binary()))
    groups = list(repeats._groups(at))
    assert len(groups) > 3 and groups[0][0] == 0 and groups[-1][1] == len(texts)
    assert all(a[1] == b[0] for a, b in zip(groups, groups[1:], strict=False))
    together = [(i + int(r[0]), *map(int, r[1:])) for i, stop in groups for runs in repeats._window_runs(data[at[i] : at[stop]], at[i : stop + 1] - at[i], 400) for r in zip(*runs, strict=True)]
    alone = [(i, *map(int, r[1:])) for i, t in enumerate(texts) for runs in repeats._window_runs(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 400) for r in zip(*runs, strict=True)]
    assert together == alone
    # plainly: each window has one run, by its smallest 64-byte gram, with the places of that gram in the run's windows
    for i in (1, 2, 4, 6, 7):
        grams = (repeats._grams(np.frombuffer(texts[i], np.uint8), 64) >> np.uint64(20)).astype(np.int64).tolist()
        least = [min(grams[p : p + 337]) for p in range(len(texts[i]) - 399)]
        runs = [r[1:] for r in alone if r[0] == i]
        assert [v for v, a, z, _ in runs for _ in range(a, z + 1)] == least and [p for _, a, z, _ in runs for p in range(a, z + 1)] == list(range(len(least)))
        for v, a, z, n in runs:
            assert n == min(2, grams[a : z + 337].count(v))


def test_kept_text_leaves_python_once(spark):
    passage = "é" * 250  # 500 bytes
    rows = [(1, "a" + passage + "b"), (2, passage + "c"), (3, "ö" + passage), (4, None), (5, "short é")]
    out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: (bytes(r.kept), r.kept_text) for r in out.collect()}
    assert out.columns[-2:] == ["kept", "kept_text"]
    assert found == {1: (b"ab", "ab"), 2: (b"c", "c"), 3: ("ö".encode(), "ö"), 4: (b"", ""), 5: ("short é".encode(), "short é")}
    # a span that starts inside a character: the byte before it stays in kept, not in the text
    half = [(1, "é" + "x" * 500), (2, "ĩ" + "x" * 500)]  # c3 a9 and c4 a9
    cut = {r.doc_id: (bytes(r.kept), r.kept_text) for r in repeats.remove_repeats(spark.createDataFrame(half, "doc_id long, text string")).collect()}
    assert cut == {1: (b"\xc3", ""), 2: (b"\xc4", "")}
    # Python hands a text over once: kept_text is made of kept where that holds whole characters
    made = out.filter("doc_id = 5").select(F.col("kept_text"))._jdf.queryExecution().analyzed().toString()
    assert "coalesce(mended" in made
