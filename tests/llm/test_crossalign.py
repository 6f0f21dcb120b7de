"""Cross-tokenizer alignment against brute force on whole texts, short and dealt out as byte ranges."""

import collections
import hashlib
import random

import numpy as np
import pytest

from barloom.llm import crossalign
from barloom.llm.tokens import _byte_table, default_path

A, B = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b, {c: x for x, c in _byte_table().items()}


def tokens(text, vocabularies):
    """[(id, bytes)] of A and of B over the whole text."""
    a, b, back = vocabularies
    left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return left, right


def brute(rows, vocabularies):
    docs = []
    for doc_id, text in rows:
        left, right = tokens(text, vocabularies) if text else ([], [])
        raw = b"".join(x for _, x in left)
        if not text or raw != (" " + text).encode() or b"".join(x for _, x in right) != raw:
            docs.append((doc_id, [], [], []))
            continue
        ends = [list(np.cumsum([len(x) for _, x in side])) for side in (left, right)]
        cuts, groups, p, q = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for cut in cuts:
            i, j = ends[0].index(cut, p) + 1, ends[1].index(cut, q) + 1
            groups.append(([x for x, _ in left[p:i]], [x for x, _ in right[q:j]]))
            p, q = i, j
        docs.append((doc_id, left, right, groups))
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for *_, groups in docs]
    count = collections.Counter(pair for each in links for pair in set(each))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, left, right, groups), each in zip(docs, links, strict=True):
        body = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, len(left), len(right), len(groups), len(each), sum(count[p] == best[p[0]] for p in each), sum(count[p] for p in each),
                    hashlib.sha256(body.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def sample():
    r = random.Random(4)
    alphabet = ["the", "token", "isation", "naïve", "東京", "\U0001f600", "\n", "\t", "  ", ".", "<|endoftext|>", "</s>", "zzqx", "12345", "　", "é", "\x00", "AbC", "-----", "’s"]
    texts = ["".join(r.choice(alphabet) + r.choice([" ", " ", "", "\n"]) for _ in range(r.choice([1, 3, 40, 200]))) for _ in range(60)]
    texts += [None, "", " ", "   ", "a", " a", "a ", "a▁b fine", "▁", "ok\r\n ok", texts[5], texts[5], "x" * 3000, "<s> <0x41>"]
    rows = list(enumerate(texts))
    return rows + [(3, texts[3]), (3, "another"), (None, "no id"), (None, None)]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_align(spark, vocabularies):
    rows = sample()
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, block int, pieces string")
    want = brute(rows, vocabularies)
    assert found(crossalign.align(docs, A, B)) == want
    assert found(crossalign.align(docs.repartition(5), A, B, block_bytes=300)) == want


def test_byte_ranges(spark, vocabularies):
    r = random.Random(5)
    words = ["alignment", "of", "to\nkens", "東京東京", "\U0001f600\U0001f601", "x" * 90, "  gaps", "é", "<|endoftext|>"]
    rows = [(i, " ".join(r.choice(words) for _ in range(150))) for i in range(6)] + [(9, "x" * 700), (10, "é" * 400 + " end"), (None, "a▁b " * 100), (4, "again " * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(crossalign.align(docs, A, B, range_bytes=37, fan=3)) == brute(rows, vocabularies)  # every text in many ranges


def test_composition_is_associative():
    r = np.random.default_rng(1)
    size_a, size_b = np.array([1, 2, 3, 5]), np.array([1, 1, 4, 7])
    for _ in range(200):
        a = r.integers(0, 4, 60)
        end_a = np.cumsum(size_a[a])
        b = r.integers(0, 4, 100)
        end_b = np.cumsum(size_b[b])
        b, end_b = b[end_b < end_a[-1]], end_b[end_b < end_a[-1]]
        gap = int(end_a[-1] - (end_b[-1] if len(end_b) else 0))  # closed by tokens of one byte
        b, end_b = np.append(b, np.zeros(gap, int)), np.append(end_b, end_a[-1] - np.arange(gap)[::-1])
        borders = np.unique(np.concatenate(([0], r.integers(0, end_a[-1], 7), [end_a[-1]])))
        parts = []
        for start, stop in zip(borders[:-1], borders[1:]):
            own_a, own_b = ((end - size >= start) & (end - size < stop) for end, size in ((end_a, size_a[a]), (end_b, size_b[b])))
            start = tuple(int((end - size)[own][0]) if own.any() else -1 for end, size, own in ((end_a, size_a[a], own_a), (end_b, size_b[b], own_b)))
            parts.append(crossalign.fragment(a[own_a], end_a[own_a], b[own_b], end_b[own_b], start))
        whole = crossalign.fragment(a, end_a, b, end_b, (0, 0))
        left = parts[0]
        for p in parts[1:]:
            left = crossalign.compose(left, p, size_a, size_b)
        right = parts[-1]
        for p in parts[-2::-1]:
            right = crossalign.compose(p, right, size_a, size_b)
        for made in (left, right):
            assert all(np.array_equal(made[c], whole[c]) for c in whole)


def test_empty(spark):
    assert crossalign.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
