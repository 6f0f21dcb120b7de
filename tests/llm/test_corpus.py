"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import editcount, mixing, packing, quality, repeats, similar, simhash, tokenbin, tokens, topk, toxicity, warc
from barloom.llm.common import stored
from barloom.llm.components import components
from barloom.llm.suffixes import suffix_ranks
from barloom.session import work_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, body string"  # th, body: clashing names
SF = "/root/testdata/sf0.001"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{r.choice(['', ',', '.'])}" for _ in range(n))


def table(spark, texts, sources=None, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["a", "b", None])[i % len(sources or [0, 1, 2])], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    base, passage = words(300, 1), words(90, 2)
    out = [None, "", " \n\t", "one", "two words", base, base, base + " more here", passage + " " + words(120, 3), words(50, 4) + " " + passage,
           "ab " * 400, "naïve café 東京 \U0001f600 " * 60, words(9000, 5), "x" * 3000, words(300, 6) + "\n" + words(300, 6)]
    return out + [words(80 + i, 50 + i) for i in range(10)]


def fresh(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# 1
def brute_top(rows, queries, k):
    out = []
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark):
    r = random.Random(1)
    vectors = [(i, [r.uniform(-2, 2) for _ in range(24)]) for i in range(230)] + [(300, [0.5] * 24), (301, [0.5] * 24), (302, [1.0] * 3), (303, [2.0] * 3)]
    odd = [(400, None), (401, [float("nan")] * 24), (402, [1.0, None] * 12), (403, [float("inf")] + [0.0] * 23), (404, []), (None, [1.0] * 24), (300, [0.5] * 24)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, vector array<float>").withColumn("vector", topk.scaled(F.col("vector")))
    rows = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in vectors]
    got = topk.top_k(df, df.filter("vec_id % 10 = 0"), k=7, block=60)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, [x for x in rows if x[0] % 10 == 0], 7)
    few = topk.top_k(df.filter("vec_id in (302, 303)"), df.filter("vec_id = 302"), k=7)
    assert [tuple(x) for x in few.collect()] == [(302, 1, 303, 64 * 128 * 3)]
    assert topk.top_k(df.filter("false"), df.filter("false")).count() == 0


def test_bound_is_above_product():
    r = np.random.default_rng(2)
    q, c = r.normal(size=(30, 40)), r.normal(size=(50, 40))
    before = np.full((30, 50), np.inf)
    for n in topk._levels(40):
        bound = topk.segment_stats(q, n) @ topk.segment_stats(c, n).T
        assert (bound >= q @ c.T - 1e-9).all()
        before = np.minimum(before, bound)


# 2
def brute_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), base


def test_quality(spark, texts):
    odd = ["a b c d " * 30, "tab\tsep\x0bvt\x0cff\r\nline\n\nline\nline \nline", "### $$$ <a> & | *" * 20]
    docs = table(spark, texts + odd, langs=[None if i % 7 == 3 else "en" for i in range(len(texts + odd))])
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t in enumerate(texts + odd):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t), i
        assert not (r.kept and r.base_failed)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert quality.quality(fresh(spark)).count() == 0 and quality.keep_good(fresh(spark)).count() == 0


def test_js_distance():
    p, q = np.array([[1.0, 0, 3], [0, 0, 0], [2, 2, 2]]), np.array([0.0, 2, 2])
    half = lambda a, m: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    a, b = p[0] / 4, q / 4
    want = np.sqrt((half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2)
    chance = 1 / (8 * np.log(2) * 4)  # two classes, four draws
    assert np.allclose(quality.js_distance(p, q)[:2], [np.sqrt(want**2 - chance), 0])


def test_quality_finds_junk(spark):
    often = ["the", "of", "and", "in", "to", "is"] * 25
    good = [" ".join(random.Random(i).sample(often + words(150, i, 10**6).split(), 200)) for i in range(40)]
    junk = [" | ".join(f"z{random.Random(i * 99 + k).randrange(10**6)}###" for k in range(100)) for i in range(3)]
    got = {r.doc_id: r.kept for r in quality.quality(table(spark, good + junk)).collect()}
    assert all(got[i] for i in range(40)) and not any(got[i] for i in range(40, 43))


def test_rare_language_has_its_own_reference(spark):
    latin = ["the", "of", "and", "in", "to", "is"] * 25
    good = [" ".join(random.Random(i).sample(latin + words(150, i, 10**6).split(), 200)) for i in range(300)]
    greek = ["και", "το", "της", "στην", "για", "με"] * 25
    rare = [" ".join(random.Random(i).sample(greek + [f"λέξη{random.Random(i * 999 + k).randrange(10**6)}" for k in range(100)], 200)) for i in range(6)]
    junk = [" | ".join(f"z{random.Random(i * 99 + k).randrange(10**6)}###" for k in range(100)) for i in range(1)]
    langs = ["en"] * 290 + [None] * 10 + ["el"] * 7
    docs = table(spark, good + rare + junk, langs=langs)
    for share in (0.001, 0.05):  # "el" held by the tasks, and as a table
        got = {r.doc_id: r.kept for r in quality.quality(docs, lang_share=share).collect()}
        assert all(got[i] for i in range(306)) and not got[306]
        assert sorted(r.doc_id for r in quality.keep_good(docs, lang_share=share).collect()) == list(range(306))


def test_words_below_the_share_do_not_count(spark):
    # "edge" has 0.45 % of the words: a candidate in one slice, where others do not hide it, or in none
    texts = [" ".join(["the", "of"] * 60 + [f"u{i}_{k}" for k in range(80)]) for i in range(60)]
    texts = [t.replace(f"u{i}_0 ", "edge ") if i >= 6 else t for i, t in enumerate(texts)]
    docs = table(spark, texts)
    assert 0.004 < sum(t.split().count("edge") for t in texts) / sum(len(t.split()) for t in texts) < 0.005
    got = [sorted((r.doc_id, r.word_distance) for r in quality.quality(docs.repartitionByRange(n, "doc_id")).collect()) for n in (1, 60)]
    assert got[0] == got[1]
    assert len({round(d, 12) for _, d in got[0]}) == 1  # with and without "edge" alike


# 3
def brute_removed(bodies, width):
    seen = collections.Counter(b[p : p + width] for b in bodies for p in range(len(b) - width + 1))
    out = []
    for b in bodies:
        hit = np.zeros(len(b) + 1, int)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                hit[p] += 1
                hit[p + width] -= 1
        gone = np.cumsum(hit)[:-1] > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_repeats(spark, texts):
    r = random.Random(4)
    hard = ["".join(r.choice("ab") for _ in range(900)) for _ in range(3)]
    core = "".join(r.choice("abcd ") for _ in range(1500))
    hard += [core[:700] + hard[0][:50], hard[1][:30] + core[290:700], core[300:699] + "!", core[200:1100] + core[:420], "abcde" * 200, "q" + "abcde" * 130, core[100:501] + "Z" + core[102:503]]
    hard += [core[1000:1500], core[1000:1410] + "!", "?" + core[1050:1500], "%" + core[1001:1411] + core[1060:1480]]  # regions that overlap in bytes
    mixed = texts + hard + [core[k : k + 400 + 37 * k % 300] + f"#{k}" for k in range(0, 900, 90)]
    df = table(spark, mixed).withColumnRenamed("doc_id", "id").withColumn("id", F.when(F.col("id") != 7, F.col("id")))
    got = repeats.remove_repeats(df, doc_id="id", carry="n_chars")
    assert got.columns[1] == "n_chars"
    want = sorted(zip([i if i != 7 else -1 for i in range(len(mixed))], brute_removed([(t or "").encode() for t in mixed], 400)))
    found = sorted(((-1 if x.doc_id is None else x.doc_id), (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)) for x in got.collect())
    assert found == want
    assert repeats.remove_repeats(fresh(spark)).count() == 0


def test_repeated_rows_are_repeats(spark):
    text = words(100, 9)
    df = spark.createDataFrame([(1, text), (1, text), (2, "short"), (2, "short")], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_removed) for x in repeats.remove_repeats(df).collect())
    assert got == [(1, len(text)), (1, len(text)), (2, 0), (2, 0)]


def test_suffix_ranks(spark):
    r = random.Random(3)
    base = [r.randint(0, 3) for _ in range(60)]
    strings = [[r.randint(0, 3) for _ in range(r.randint(0, 9))] + base[r.randint(0, 20) : r.randint(25, 60)] for _ in range(12)] + [[], [1], [1, 2], [5] * 20, [5] * 19]
    got = {x.sid: x.ranks for x in suffix_ranks(spark.createDataFrame(list(enumerate(strings)), "sid long, s array<long>"), 1000).collect()}
    suffixes = sorted((tuple(s[i:]), got[k][i]) for k, s in enumerate(strings) for i in range(len(s)))
    for (a, x), (b, y) in zip(suffixes, suffixes[1:]):
        assert (a == b) == (x == y) and x <= y


# 4
def test_toxicity(spark):
    r = random.Random(5)
    bad = ["idiot", "1d10t", "іdiot", "IDIOTS!"]
    rows = []
    for i in range(400):
        body = words(60, 1000 + i, 3000).split()
        toxic = i % 4 == 0
        if toxic:
            body[r.randrange(60)] = bad[i // 4 % 4]
        elif i % 9 == 0:
            body[10:11] = ["village", "idiot", "festival"]  # an exception phrase
        rows.append((i, " ".join(body), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert any(e.startswith("village idiot") for e in lexicon.exceptions)
    extra = spark.createDataFrame([(1000, None), (1001, ""), (None, "you idiot")], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.toxicity(df.select("doc_id", "text").union(extra), lexicon).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == rows[i][2] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    assert got[1000].predicted == 0 == got[1001].predicted
    none = toxicity.learn(df.select("doc_id", "text").filter("false"), df.select("doc_id", "toxic").filter("false"))
    assert none.weights == () and toxicity.toxicity(extra, none).filter("score > 0").count() == 0


def test_folding():
    assert toxicity.folded("St0p! ѕtup1d, 1984 a­b") == ["stop", "stupid", "1984", "ab"]


# 5, 6, 10
ODD = ["", None, "a  b", "  lead", "trail  ", "it's don't\n\nx", "a  b", "x 　y", "naïve 東 12", "<|endoftext|> hi", "İ ß Σ", "a" * 3000, "\x00 b", "é ́a"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    import pyarrow as pa
    from tokenizers import Tokenizer

    r = random.Random(1)
    letters = [*"ab c'sS.!9é ß   \n\t#", "'ll", " the", " 東"]
    all_texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(500)]
    path = tokens.default_path(name)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    want = [e.ids for e in whole.encode_batch([t or "" for t in all_texts], add_special_tokens=False)]
    for most in (600_000, 5):
        own = tokens.Encoder(path, most)
        for part in (all_texts[:200], all_texts[200:]):
            ids, at = own.encode(pa.array(part, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want[all_texts.index(part[0]) :][: len(part)]


def encoded(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_edit_counts(spark, texts):
    rows = [(i, t, [(5, 3, "new words"), (6, 4, None), (10**6, 2, "!"), (-4, 1, " lead ")]) for i, t in enumerate(texts + ODD)] + [(99, texts[5], None)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {editcount.EDITS}").repartition(2)
    path = tokens.default_path("byte_bpe_50k.json")
    derived = df.select("doc_id", "text", F.lit(1).alias("tokens")).withColumn("edits", editcount.derived_edits())
    for source in (df, derived):
        given = {x.doc_id: x for x in source.collect()}
        got = editcount.apply_edits(editcount.count_trees(source, path, leaf_bytes=64, carry="edits"), path).collect()
        assert len(got) == len(given)
        new = []
        for x in got:
            text, out, at, done = given[x.doc_id].text or "", [], 0, 0
            for e in sorted(given[x.doc_id].edits or [], key=lambda e: e["at"]):
                start = max(done, min(max(e["at"], 0), len(text)))
                stop = max(start, min(e["at"] + e["remove"], len(text)))
                done, out, at = stop, [*out, text[at:start], e["insert"] or ""], stop
            new.append("".join([*out, text[at:]]))
        assert [x.text for x in got] == new
        assert [x.n_tokens for x in got] == [len(i) for i in encoded("byte_bpe_50k.json", new)]
        assert all(x.tokens[1] == x.n_tokens and x.chars[1] == len(t) for x, t in zip(got, new))
        assert max(x.n_touched for x in got if x.n_leaves > 100) < 20
    assert editcount.count_trees(fresh(spark), path).count() == 0


def test_packing(spark, texts):
    docs = table(spark, texts + [texts[5]])
    got = packing.pack(packing.pieces(docs, tokens.default_path("word_bpe_49k.json"), capacity=512), capacity=512).collect()
    want = []
    for i, ids in enumerate(encoded("word_bpe_49k.json", texts + [texts[5]])):
        ids = [*ids, 1]
        want += [(i, k // 512, k, len(ids[k : k + 512]), crc(ids[k : k + 512])) for k in range(0, len(ids), 512)]
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    by = collections.defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 512
    assert packing.pack(packing.pieces(fresh(spark), tokens.default_path("word_bpe_49k.json"))).count() == 0


def test_plan_is_tight():
    r = np.random.default_rng(8)
    for _ in range(5):
        lengths, counts = np.unique(np.minimum(4096, r.lognormal(6, 1, 5000).astype(int) + 1), return_counts=True)
        runs, n = packing.plan_runs(lengths, counts, 4096)
        assert runs[:, 2].sum() == counts.sum()
        assert n <= 1.01 * -(-int((lengths * counts).sum()) // 4096) + 1


def test_token_files(spark, texts):
    docs = table(spark, texts)
    path = work_dir(spark, "t")
    tokenbin.write_token_files(docs, path, tokens.default_path("byte_bpe_50k.json"))
    rows = tokenbin.read_token_files(spark, path)
    ids = [[*x, 2] for x in encoded("byte_bpe_50k.json", texts)]
    assert {x.doc_id: x.ids for x in rows.collect()} == dict(enumerate(ids))
    start = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    assert sorted(map(tuple, tokenbin.token_index(rows).collect())) == [(i, start[i], len(x), crc(x)) for i, x in enumerate(ids)]
    assert [x.ids for x in rows.filter("doc_id = 8").collect()] == [ids[8]]
    empty = work_dir(spark, "t")
    tokenbin.write_token_files(fresh(spark), empty, tokens.default_path("byte_bpe_50k.json"))
    assert tokenbin.token_index(tokenbin.read_token_files(spark, empty)).count() == 0
    double = work_dir(spark, "t")
    tokenbin.write_token_files(docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id"))), double, tokens.default_path("byte_bpe_50k.json"))
    got = sorted((x.start, x.n_tokens) for x in tokenbin.token_index(tokenbin.read_token_files(spark, double)).collect())
    assert [a for a, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))]


# 7
def test_warc(spark):
    big, gz = "<p>" + "lorem " * 400, "\x1f\x8b\x08" * 500
    pages = [(1, "http://a/", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "tiny"), (7, "u", "tiny"), (8, "u", gz), (9, "u", "WARC/1.1\r\n\r\n" * 99), (10, "u", "x" * 300_000), (None, "u", "null id" * 200)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(3)
    path = work_dir(spark, "w")
    manifest = warc.write_warc(df, path, level=0)  # stored members: magic inside the data is visible
    want = {}
    for i, _, html in pages:
        body = (html or "").encode()
        to = 3 if i in (1, 2) else None
        want[i] = ("revisit" if to else "response", to, len(body), hashlib.sha1(body).hexdigest(), None if to else body)
    for split in (97, 1000, 1 << 22):
        got = warc.read_warc(manifest, path, split_bytes=split).collect()
        assert len(got) == len(pages)
        assert {x.page_id: (x.record_type, x.refers_to, x.payload_bytes, x.payload_digest, x.payload and bytes(x.payload) if x.payload is not None else None) for x in got} == want
    none = warc.write_warc(df.filter("false"), path + "0")
    assert warc.read_warc(none, path + "0").count() == 0


# 8
def brute_print(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(values, bits):
    low = {v: v for v in values}

    def top(v):
        while low[v] != v:
            v = low[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin(a ^ b).count("1") <= bits:
                low[top(b)] = top(a)
    return {v: top(v) for v in values}


def test_near_duplicates(spark, texts):
    more = texts + [texts[12] + " tail", "ÉCOLE Ab " * 9, " One "]
    got = {x.doc_id: x for x in simhash.near_duplicates(table(spark, more)).collect()}
    prints = {i: brute_print(t, 3) for i, t in enumerate(more)}
    assert {i: x.fp & (1 << 64) - 1 for i, x in got.items()} == prints
    classes = brute_classes(set(prints.values()), 3)
    assert {i: x.component_id for i, x in got.items()} == {i: min(j for j in prints if classes[prints[j]] == classes[prints[i]]) for i in prints}
    assert simhash.near_duplicates(fresh(spark)).count() == 0


def test_links_of_dense_lists(spark):
    r = random.Random(6)
    seeds = [r.getrandbits(64) for _ in range(6)]
    values = {s ^ sum(1 << b for b in r.sample(range(24), r.randint(0, 6))) for s in seeds for _ in range(60)} | {r.getrandbits(64) for _ in range(50)} | {0, 1, (1 << 64) - 1}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    label = {x.node & (1 << 64) - 1: x.label & (1 << 64) - 1 for x in components(simhash.link_fingerprints(df)).collect()}
    classes = collections.defaultdict(set)
    for v, c in brute_classes(values, 3).items():
        classes[c].add(v)
    for members in classes.values():
        assert len({label.get(v, v) for v in members}) == 1 or len(members) == 1
        assert len(members) > 1 or members.pop() not in label
    own = np.array(sorted(values), np.uint64)
    key = np.zeros(len(own), np.uint64)  # one list of positions 0-4: the long form finds the same pairs
    same = own[(own >> np.uint64(40)) == 0]
    a, b = simhash._long_run(np.arange(0, 6000, dtype=np.uint64) << np.uint64(40), 0, 3)
    assert len(a) == 5999 and len(same) + len(key) > 0


def near_copies():
    """Texts of 120 words with copies at every similarity from 0.6 to 1, chains, a large group, and one common passage."""
    r, out = random.Random(11), [None, "", "one two", "one two"]
    for i in range(30):
        base = words(120, 500 + i, 10**6).split()
        out.append(" ".join(base))
        for k in range(1, 5):
            copy = list(base)
            for j in r.sample(range(120), k):
                copy[j] = f"new{i}_{k}_{j}"
            out.append(" ".join(copy))
    hub = words(150, 900, 10**6).split()
    out += [" ".join(hub[:k] + [f"x{k}"] + hub[k + 1 :]) for k in range(0, 150, 2)]
    passage = words(60, 901, 10**6)
    return out + [passage + " " + words(30 + i, 950 + i, 10**6) for i in range(60)]


def test_similar_groups(spark):
    texts = near_copies()
    sets = [set(similar.shingle_set((t or "").encode(), 5).tolist()) for t in texts]
    low = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if low[i] != low[j] and (100 * len(a & b) >= 80 * len(a | b)):
                old, new = max(low[i], low[j]), min(low[i], low[j])
                low = [new if x == old else x for x in low]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(5)
    got = collections.defaultdict(set)
    for x in similar.similar_groups(df).collect():
        got[x.group].add(x.key)
    want = collections.defaultdict(set)
    for i, x in enumerate(low):
        want[x].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert similar.similar_groups(df.filter("false")).count() == 0


def test_stage_drops_copies_of_low_similarity(spark):
    import corpus_pipeline as p

    base = words(120, 77, 10**6).split()
    copy = list(base)
    copy[30] = copy[60] = "other"  # 106 of 126 shingles: similarity 0.84
    docs = table(spark, [" ".join(base), " ".join(copy), words(120, 78, 10**6)])
    assert sorted(r.doc_id for r in p.keep_distinct(spark, docs, SF).collect()) == [0, 2]


def test_stage_keeps_distinct_texts_of_one_id(spark):
    import corpus_pipeline as p

    one, two = words(120, 81, 10**6), words(120, 82, 10**6)
    rows = [(7, one, "en", "b", 1), (7, one, "en", "a", 1), (7, two, "en", "a", 1), (8, two + " end", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text, r.source) for r in p.keep_distinct(spark, docs, SF).collect())
    assert got == sorted([(7, one, "a"), (7, two, "a")])


# 9
def test_mixing(spark):
    rows = [(i, "abcdef"[min(i % 13 // 2, 5)] if i % 13 else None, f"t{i}", 1) for i in range(2600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, w int")
    got = mixing.mix(df, block_docs=4, rows_per_range=100).collect()
    assert len(got) == 2600 and got[0].text.startswith("t")
    sizes = collections.Counter(r[1] for r in rows)
    target = {x.source: x.w for x in mixing.target_weights(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, rows long")).collect()}
    total = sum(target.values())
    order = collections.defaultdict(list)
    for x in got:
        assert x._release <= x._slot < x._due
        order[x._slot].append(x)
    ends = min(max(x._slot for x in got if x.source == s) for s in sizes)
    count = collections.Counter()
    for slot in range(ends):
        assert len({(x.source, x._block) for x in order[slot]}) == 1 and sorted(x._place for x in order[slot]) == list(range(len(order[slot])))
        count[order[slot][0].source] += 1
        assert all(abs(count[s] - w * (slot + 1) / total) < 1 for s, w in target.items())
    for s in sizes:
        mine = sorted((x for x in got if x.source == s), key=lambda x: (x._slot, x._place))
        assert [x.doc_id for x in mine] == sorted((x.doc_id for x in mine), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    given = spark.createDataFrame([("a", 3), ("b", 1)], "source string, w long")
    two = mixing.mix(df.filter("source in ('a', 'b')"), given, block_docs=1).collect()
    assert len(two) == sizes["a"] + sizes["b"]
    assert mixing.mix(df.filter("false")).count() == 0
    assert "MapInArrow" not in mixing.mix(df)._jdf.queryExecution().toString()


def test_packing_follows_mixture(spark):
    import corpus_pipeline as p

    # one length of 1,024 ids: four pieces a sequence; 3,000 rows of a, 300 of b, ids in order of sources
    rows = [(i, "the " * 1023, "en", "a" if i < 3000 else "b", 0) for i in range(3300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = p.pack(spark, docs, SF).collect()
    assert {x.length for x in got} == {1024} and len({x.doc_id for x in got}) == 3300 and len(got[0]) == 7
    assert {x.sequence_id for x in got} == set(range(825))
    sizes = {"a": 3000, "b": 300}
    share = sizes["b"] ** 0.5 / (sizes["a"] ** 0.5 + sizes["b"] ** 0.5)
    for prefix in (80, 160, 240, 300):  # b ends after about 310 sequences
        first = [x.doc_id for x in got if x.sequence_id < prefix]
        assert abs(sum(i >= 3000 for i in first) - share * len(first)) <= 32  # two blocks


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.limit(1)
    docs = docs.union(first).union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("extra", F.lit(1))
    good = p.keep_good(spark, docs, SF).persist()
    judged = quality.quality(docs)
    assert good.count() == judged.filter("kept").count()
    distinct = p.keep_distinct(spark, good, SF).persist()
    rows = {r.doc_id: r.text for r in good.filter("doc_id IS NOT NULL").collect()}
    sets = {i: set(similar.shingle_set((t or "").encode(), 5).tolist()) for i, t in rows.items()}
    low = {i: i for i in rows}
    for i in sorted(rows):  # components of Jaccard 0.8 by brute force
        for j in sorted(rows):
            if j < i and low[i] != low[j] and (100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])):
                old, new = max(low[i], low[j]), min(low[i], low[j])
                low = {k: new if v == old else v for k, v in low.items()}
    assert sorted(r.doc_id for r in distinct.filter("doc_id IS NOT NULL").collect()) == sorted(set(low.values()))
    assert distinct.filter("doc_id IS NULL").count() == good.filter("doc_id IS NULL").count()
    cut = p.cut_repeats(spark, distinct, SF).persist()
    before, after = distinct.collect(), cut.collect()
    want = brute_passages([r.text for r in before], p.PASSAGE_WORDS)
    assert sorted((r.doc_id is None, r.doc_id, (r.text or "").encode().split()) for r in after if r.doc_id is not None) == sorted(
        (r.doc_id is None, r.doc_id, left) for r, (_, _, left) in zip(before, want) if r.doc_id is not None)
    assert len(after) == len(before) and any(gone for _, gone, _ in want)
    kept = {r.doc_id: r for r in after}
    assert all(kept[r.doc_id] == r for r, (_, gone, _) in zip(before, want) if r.doc_id is not None and not gone)
    assert all(r.n_chars == len(r.text) for r, (_, gone, _) in zip([kept[b.doc_id] for b in before], want) if gone and r.doc_id is not None)
    mixed = stored(p.interleave(spark, cut, SF), "mixed")
    assert mixed.columns == list(p.COLUMNS) and mixed.count() == cut.count()
    packed = p.pack(spark, mixed, SF).persist()
    assert packed.agg(F.sum("length")).first()[0] == sum(len(i) + 1 for i in encoded("word_bpe_49k.json", [r.text for r in after]))
    # the order that the mixing stage hands over is that of the sequences
    other = stored(mixed.repartitionByRange(3, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")), "other")
    moved = p.pack(spark, other, SF)
    places = lambda df: sorted(map(repr, df.select("doc_id", "piece", "sequence_id").collect()))
    assert moved.count() == packed.count() and places(moved) != places(packed)
    for _, stage in p.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0


def brute_passages(texts, size):
    """Per text: the words left when every word in a run of `size` words that also starts elsewhere goes."""
    lists = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[p : p + size]) for w in lists for p in range(len(w) - size + 1))
    out = []
    for w in lists:
        gone = set()
        for p in range(len(w) - size + 1):
            if seen[tuple(w[p : p + size])] > 1:
                gone |= set(range(p, p + size))
        out.append((len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


def test_passages(spark, texts):
    run, other = words(60, 901, 10**6).split(), words(400, 902, 10**6).split()
    planted = [run[:50] + other[:40], other[40:70] + run[:50], other[80:120] + run[:49] + other[120:130], other[130:150] + run[:49] + ["last"], run[5:60] + other[200:260], other[260:300] + run[5:60] + run[:51]]
    short = ["a b " * 30, "ab " * 49, "ab " * 50, "x y z " * 16 + "x y", "x y z " * 16 + "x y z q"]
    mixed = texts + [" ".join(x) for x in planted] + ["\n\t ".join(planted[0])] + short
    df = table(spark, mixed).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    got = repeats.remove_passages(df, 50, carry="n_chars").collect()
    want = brute_passages(mixed, 50)
    assert sorted((r.n_words, r.n_removed, r.kept_text.encode().split()) for r in got) == sorted(want)
    assert any(0 < gone < n for n, gone, _ in want) and sum(gone == 0 for _, gone, _ in want) > 10
    whole = {r.n_chars: r.kept_text for r in got if not r.n_removed}
    assert all(whole[len(t or "")] == (t or "") for t, (_, gone, _) in zip(mixed, want) if not gone and sum(len(t or "") == len(u or "") for u in mixed) == 1)
    assert repeats.remove_passages(df.filter("false"), 50).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_passages(df, 49)


def test_signatures_bound_the_difference():
    r = np.random.default_rng(3)
    for n, m, shared in ((300, 280, 250), (5, 5, 0), (900, 1000, 100), (1, 0, 0)):
        both = r.integers(0, 1 << 63, n + m, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        a, b = both[:n], np.concatenate((both[:shared], both[n : n + m - shared]))
        differ = int(np.bitwise_count((similar.signature(a) ^ similar.signature(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_mixing_passes_all_rows_and_columns_on(spark):
    rows = [(i, "ab"[i % 2], i, f"r{i}", 0.5 * i, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _key long, _range string, _local double, w string")
    got = mixing.mix(df, block_docs=4)
    assert got.columns[:6] == df.columns and sorted(tuple(r[:6]) for r in got.collect()) == sorted(rows)
    weights = spark.createDataFrame([("a", 3)], "source string, w long")
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(df, weights).collect()
    assert mixing.mix(df.filter("source = 'a'"), weights).count() == 30
    with pytest.raises(ValueError):
        mixing.mix(df.withColumn("_slot", F.lit(1)))


def test_near_duplicates_come_through_fingerprints(spark, monkeypatch):
    import corpus_pipeline as p

    # texts without a shared list leader: links of the fingerprints alone must join them
    r = np.random.default_rng(8)
    base = [" ".join(f"w{x}" for x in r.integers(0, 5000, 400)) for _ in range(4)]
    texts = [t for b in base for t in (b, b + " tail", "head " + b)] + ["short", None]
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    asked, verified, lists = [], [], similar._lists
    link, verify = similar.link_fingerprints, similar._verified
    monkeypatch.setattr(similar, "link_fingerprints", lambda prints: asked.append(prints.count()) or link(prints))
    monkeypatch.setattr(similar, "_verified", lambda pairs, *more: verified.append(pairs.count()) or verify(pairs, *more))
    assert sorted(x.doc_id for x in p.keep_distinct(spark, docs, SF).collect()) == [0, 3, 6, 9, 12, 13]
    assert asked and verified[0]
    # without any list of the prefix index the fingerprints' pairs still join the copies
    monkeypatch.setattr(similar, "_lists", lambda postings: stored(lists(postings).filter("false"), "lists"))
    assert sorted(x.doc_id for x in p.keep_distinct(spark, docs, SF).collect()) == [0, 3, 6, 9, 12, 13]


def test_rows_that_pass_bring_their_text_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    docs = docs.union(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).union(docs.limit(2).withColumn("lang", F.lit("zz")))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    good = quality.quality(docs.withColumn("doc_id", F.xxhash64("doc_id", "lang", "text"))).filter("kept")
    assert sorted(r[0] for r in kept.select(F.xxhash64("doc_id", "lang", "text")).collect()) == sorted(r.doc_id for r in good.collect())
    passed = [x for x in kept._jdf.queryExecution().executedPlan().toString().split("\n") if "MapInArrow run" in x]
    assert passed and not any(x.split("MapInArrow run(")[1].split(")")[0].count("text#") for x in passed)
