"""Quality rules with distribution divergence (operator 2).

Each text gives two histograms: character classes, and the common words of its language. Both are compared by
Jensen-Shannon distance with the reference of the language, which is summed over every document of that language. A text
that is too short for a histogram to mean anything passes that comparison (minimum-length guards).

Common words are the words with at least `word_share` of a language's words. A first pass counts per piece of input and
passes on the words above `word_share / 5` of the piece, so no total is short by more than that share and no common word
is missed; a second pass counts the candidates exactly, and those below the share are counted with all other words. Every language has a reference of its own, rows without a language
have one together. The words per language are bounded by `word_share`; references of the languages with `lang_share` of all
rows (a bounded number) are held by every task, those of all others stay a table that is joined on the language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import read, slices, stored

#: Fixed: the symbols counted by n_symbols.
SYMBOLS = b"#*$%&|<>"
#: Character classes by byte; every code point outside ASCII is one class, counted at its first byte.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "other_ascii", "wide")
_CLASS = np.full(256, 7)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 32]] = 3
_CLASS[[10, 13]] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[list(SYMBOLS + b"@=+/\\_~^`{}[]")] = 6
_CLASS[128:] = 8
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True  # bytes inside a code point


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words found twice or more in the text, the first one included."""
    if len(words) <= width:
        return 0
    x = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    x = x * np.uint64(0x9E3779B97F4A7C15) ^ x >> np.uint64(31)
    value = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        value = (value ^ value >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + x[k : k + len(value)]
    if len(set(value.tolist())) == len(value):
        return 0
    order = np.argsort(value)
    same = value[order[1:]] == value[order[:-1]]
    at = np.concatenate((order[1:][same], order[:-1][same]))
    edge = np.zeros(len(words) + 1, np.int64)
    twice = np.zeros(len(value), bool)
    twice[at] = True
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _held_languages(docs: DataFrame, lang_share: float) -> tuple[list[str], bool]:
    """Languages whose references are held by every task: at most 1 / lang_share; and whether there are others."""
    least = lang_share * docs.count()
    sizes = docs.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("rows"))
    held = sorted(row.lang for row in sizes.filter(F.col("rows") >= least).collect())
    return held, sizes.count() > len(held)


def _common_words(docs: DataFrame, word_share: float) -> DataFrame:
    """(lang, words): candidate words of every language in order, at most 5 / (4 word_share) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts: dict[str | None, Counter] = defaultdict(Counter)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if text:
                        counts[lang].update(text.lower().split())
                rows: list[tuple] = []
                for lang, count in counts.items():
                    total = count.total()
                    rows.append((lang, None, total))
                    rows += [(lang, w, n) for w, n in count.items() if 5 * n >= word_share * total]
                columns = zip(*rows, strict=True) if rows else ((), (), ())
                kinds = (pa.string(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["lang", "word", "n"])

    counted = docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    of = F.max(F.when(F.col("word").isNull(), F.col("n"))).over(Window.partitionBy("lang"))
    words = counted.withColumn("of", of).filter((F.col("n") >= 0.8 * word_share * F.col("of")) & F.col("word").isNotNull())
    return words.groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("words"))


def _joined(docs: DataFrame, table: DataFrame, held: list[str], others: bool, lang: str = "lang") -> DataFrame:
    """docs with the columns of a table of languages: joined where tasks do not hold the language, else null."""
    known = F.col(lang).isNull() | F.col(lang).isin(held)
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != "lang"]
    out = docs.filter(known).select("*", *more)
    if not others:
        return out
    table = table.withColumnRenamed("lang", "_lang").filter("_lang IS NOT NULL")
    return out.union(docs.filter(~known).join(table, F.col(lang) == F.col("_lang"), "left").drop("_lang").select(*out.columns))


NAMES = ("doc_id", "ref", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common")
_COUNTS = NAMES[2:7]


def _measure(part: pa.RecordBatch, words: dict[str | None, list[bytes]]) -> tuple[list[str | None], list[list]]:
    """Language, and the base counts and both histograms (in the order of NAMES) of the rows of a batch. words: those of the
    held languages; the rows of others bring theirs."""
    rows: list[list] = [[] for _ in NAMES[2:]]
    key = []
    for lang, text, own in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), part.column("words"), strict=True):
        text = text or b""
        split = text.split()
        hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        lines = [x for x in text.split(b"\n") if x.strip()]
        count = Counter(text.lower().split())
        key.append(lang)
        common = [count[w] for w in (words[lang] if lang in words else own.as_py() or [])]
        hist[_INNER] = 0
        classes = np.bincount(_CLASS, weights=hist, minlength=len(CLASSES)).astype(np.int64)
        for to, value in zip(rows, (
            len(split), int(hist.sum()) - int(hist[9:14].sum()) - int(hist[32]), int(hist[list(SYMBOLS)].sum()),
            len(lines) - len(set(lines)), repeated_words(split), classes.tolist(), [*common, len(split) - sum(common)],
        ), strict=True):
            to.append(value)
    return key, rows


def _measured(docs: DataFrame, words: dict[str | None, list[bytes]]) -> DataFrame:
    """The base counts and both histograms of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                key, rows = _measure(part, words)
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
                arrays = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key, pa.string()), *arrays], [*NAMES])

    return docs.mapInArrow(run, "doc_id long, ref string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>")


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts p from the counts q; 0 where either is empty.

    A sample of n draws from q itself has a squared distance of about (classes - 1) / (8 n ln 2); that much is taken off,
    so that short texts are not further away for being short.
    """
    n, m = p.sum(axis=1, keepdims=True), q.sum()
    p, q = p / np.maximum(n, 1), np.broadcast_to(q / max(m, 1), p.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(2 * p / (p + q)), 0.0) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0.0)
    by_chance = max(0, np.count_nonzero(q[0] if len(q) else q) - 1) / (8 * np.log(2) * np.maximum(n[:, 0], 1))
    return np.where((n[:, 0] > 0) & (m > 0), np.sqrt(np.maximum(parts.sum(axis=1) / 2 - by_chance, 0.0)), 0.0)


def _folded(p: np.ndarray, q: np.ndarray, share: float) -> np.ndarray:
    """Counts p of candidate words and of the rest (last): words below their share of q are moved to the rest."""
    keep = np.append(q[:-1] >= share * q.sum(), False)
    return np.concatenate((p[..., keep], p[..., ~keep].sum(axis=-1, keepdims=True)), axis=-1)


@dataclass(frozen=True)
class Rules:
    """Thresholds and references that judge a text; the parameters are those of `quality`."""

    words: dict
    refs: dict  # of the held languages
    word_share: float
    most_class: float
    most_word: float
    least_chars: int
    least_words: int

    def judge(self, key: list[str | None], rows: list[list], batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(base_failed, class distance, word distance, kept) of measured rows; nan: too short to compare. batch: has the
        references ref_classes and ref_common of the rows whose language is not a held one."""
        n_words, word_chars, _, _, n_repeat = (np.array(r, np.int64) for r in rows[:5])
        groups: dict[str | None, list[int]] = defaultdict(list)
        for i, ref in enumerate(key):
            groups[ref].append(i)
        found = {"classes": np.zeros(len(key)), "common": np.zeros(len(key))}
        for (kind, to), values in zip(found.items(), rows[5:], strict=True):
            for ref, at in groups.items():
                q = self.refs[ref, kind] if (ref, kind) in self.refs else batch.column(f"ref_{kind}")[at[0]].as_py()
                p, q = np.array([values[i] for i in at], np.float64), np.array(q, np.float64)
                if kind == "common":
                    p, q = _folded(p, q, self.word_share), _folded(q, q, self.word_share)
                to[at] = js_distance(p, q)
        by_class = np.where(word_chars >= self.least_chars, found["classes"], np.nan)
        by_word = np.where(n_words >= self.least_words, found["common"], np.nan)
        base = (n_words < 20) | (100 * n_repeat > 30 * n_words)
        return base, by_class, by_word, ~base & ~(by_class > self.most_class) & ~(by_word > self.most_word)


def _summed(rows: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): histograms of each language over all its rows."""
    place = lambda name: rows.select("ref", F.lit(name).alias("kind"), F.posexplode(name).alias("at", "n"))
    summed = place("classes").union(place("common")).groupBy("ref", "kind", "at").agg(F.sum("n").alias("n"))
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "n")))), lambda x: x["n"]).alias(f"ref_{kind}")
    return summed.groupBy(F.col("ref").alias("lang")).agg(of("classes"), of("common"))


def _inputs(docs: DataFrame, doc_id: str, text: str, lang: str, *more: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"), *more)


def quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", word_share: float = 0.005, lang_share: float = 0.001,
    most_class: float = 0.28, most_word: float = 0.25, least_chars: int = 200, least_words: int = 40,
) -> DataFrame:
    """Base counts, distances and verdict of every row of `docs`.

    kept is false if base_failed (under 20 words, or over 30 % of the words repeat in windows of eight), or the class
    distance is over most_class (texts of least_chars word characters or more), or the word distance is over most_word
    (texts of least_words words or more). A null or empty text has no words and fails the base rules. Rows without a
    language share one reference; lang_share sets where references are held, not the result. Repeated rows are judged
    alike, each on its own; an empty table gives no rows; further columns of `docs` are not read.
    """
    docs = _inputs(docs, doc_id, text, lang)
    held = _held_languages(docs, lang_share)
    rows, _, refs, rules = _fitted(docs, held, word_share, most_class, most_word, least_chars, least_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rules.judge(batch.column("ref").to_pylist(), [batch.column(c).to_pylist() for c in NAMES[2:]], batch)
            kept = [batch.column(c) for c in ("doc_id", *_COUNTS)]
            arrays = [pa.array(x, from_pandas=True) for x in found]  # nan becomes null
            yield pa.RecordBatch.from_arrays([*kept, *arrays], ["doc_id", *_COUNTS, "base_failed", "class_distance", "word_distance", "kept"])

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return _joined(rows, refs, *held, lang="ref").mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, class_distance double, word_distance double, kept boolean")


def _fitted(docs: DataFrame, held: tuple[list[str], bool], word_share: float, *thresholds: float) -> tuple[DataFrame, DataFrame, DataFrame, Rules]:
    """Measured rows, words and references of all languages as tables, and the rules with those of the held languages."""
    own = F.col("lang").isNull() | F.col("lang").isin(held[0])
    table = stored(_common_words(docs, word_share), "words")
    words: dict[str | None, list[bytes]] = {lang: [] for lang in (None, *held[0])}
    words |= {row.lang: [bytes(w) for w in row.words] for row in table.filter(own).collect()}
    rows = stored(_measured(_joined(docs, table, *held), words), "measured")
    refs = stored(_summed(rows), "refs")
    found = {(row.lang, kind): row[f"ref_{kind}"] for row in refs.filter(own).collect() for kind in ("classes", "common")}
    return rows, table, refs, Rules(words, found, word_share, *thresholds)


def keep_good(docs: DataFrame, word_share: float = 0.005, lang_share: float = 0.001, most_class: float = 0.28, most_word: float = 0.25, least_chars: int = 200, least_words: int = 40) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang and any others) that `quality` keeps: texts are shuffled only in languages that tasks do not hold.
    A text reaches its task once, in its row."""
    inputs = _inputs(docs, "doc_id", "text", "lang")
    held = _held_languages(inputs, lang_share)
    _, table, refs, rules = _fitted(inputs, held, word_share, most_class, most_word, least_chars, least_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.struct_field(batch.column("row"), "text").cast(pa.binary())
            for part in slices(batch.append_column("text", text), "text", 2 << 20):
                yield part.select(["row"]).filter(pa.array(rules.judge(*_measure(part, rules.words), part)[3]))

    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = _inputs(docs.withColumn("_row", row), "doc_id", "text", "lang", "_row").withColumnRenamed("_row", "row")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType)])
    rows = _joined(rows.select("lang", "row"), refs.join(table, "lang", "left"), *held)
    return rows.mapInArrow(run, schema).select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
