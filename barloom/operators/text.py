"""Headline scoring: substring rules compiled to column expressions.

Rule sets are dictionaries of a bounded size. A document is scanned once for all keywords of an
operator and never joined with, or exploded by, its keywords.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import lag, pct_change, rolling
from barloom.functions.rules import (
    ALERT_TRANSITIONS, IMPACT_ASSETS, NARRATIVE_IMPACT, STALENESS, TIER_WEIGHTS,
)
from barloom.functions.scalar import clip, col, ladder

Rules = Mapping[str, Sequence[str]]


def _sum(parts: Sequence[Column]) -> Column:
    out = parts[0] if parts else F.lit(0)
    for p in parts[1:]:
        out = out + p
    return out


def _word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


#: Bytes of text that a task turns into Python strings at a time.
SLICE_BYTES = 2 << 20


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Cut an array of texts so that a piece holds about SLICE_BYTES (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, seen = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, seen + SLICE_BYTES, side="right")))
        yield texts.slice(start, stop - start)
        start, seen = stop, int(ends[stop - 1])


def _counter(keywords: Sequence[str], word_boundary: bool = False):
    """Counts of all keywords in one pass over each text; the automaton is built once per task.

    Occurrences of a keyword do not overlap each other. With word_boundary an occurrence must not touch a letter, digit
    or underscore on either side, whatever characters the keyword itself has. A batch is read in pieces of bounded bytes,
    so a task holds few texts and counts as Python objects, however many rows its batch has.
    """

    @F.arrow_udf("array<int>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick  # on the executors, see requirements.txt

        automaton = ahocorasick.Automaton()
        for i, k in enumerate(keywords):
            automaton.add_word(k, (i, len(k)))
        automaton.make_automaton()

        def one(text: str) -> list[int]:
            n, last = [0] * len(keywords), [-1] * len(keywords)
            for end, (i, size) in automaton.iter(text):
                start = end - size + 1
                if start <= last[i]:
                    continue
                if word_boundary and (start and _word(text[start - 1]) or end + 1 < len(text) and _word(text[end + 1])):
                    continue
                n[i] += 1
                last[i] = end
            return n

        for batch in batches:
            found = np.zeros((len(batch), len(keywords)), np.int32)
            row = 0
            for piece in _slices(batch):
                for text in piece.to_pylist():
                    if text is not None:
                        found[row] = one(text)
                    row += 1
            at = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(keywords))
            yield pa.ListArray.from_arrays(at, pa.array(found.ravel()), mask=batch.is_null())

    return count


class Hits:
    """Keyword counts of a text: an array column with one entry per distinct keyword.

    Each text is read once by one automaton, whatever the number of keywords. (One built-in search per keyword was
    measured about fifty times slower for a table of 145 keywords.)
    """

    def __init__(self, df: DataFrame, keywords: Sequence[str], text: str = "text", word_boundary: bool = False):
        words = list(dict.fromkeys(keywords))
        self.index = {k: i for i, k in enumerate(words)}
        self.df = df.withColumn("_n", _counter(words, word_boundary)(F.lower(F.col(text))))

    def count(self, keyword: str) -> Column:
        return F.get("_n", self.index[keyword])

    def any(self, keywords: Sequence[str]) -> Column:
        return _sum([self.count(k) for k in keywords]) > 0

    def matched(self, keywords: Sequence[str]) -> Column:
        """How many of the keywords occur at least once."""
        return _sum([(self.count(k) > 0).cast("int") for k in keywords])

    def total(self, keywords: Sequence[str]) -> Column:
        return _sum([self.count(k) for k in keywords])


def _words(rules: Rules) -> list[str]:
    return [k for kws in rules.values() for k in kws]


def _context_words(contexts: Mapping[str, tuple[Sequence[str], Sequence[str], float]]) -> list[str]:
    return [k for bull, bear, _ in contexts.values() for k in (*bull, *bear)]


def with_base_score(df: DataFrame, score: Callable[[pd.Series], pd.Series], text: str = "text",
                    out: str = "base_score") -> DataFrame:
    """Hook for an own sentiment model: `score` maps a batch of texts to numbers."""

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return score(batch)

    return df.withColumn(out, run(F.col(text)))


def tag_topics(df: DataFrame, rules: Rules, text: str = "text", default: str = "General", hits: Hits | None = None) -> DataFrame:
    """Add `tags` (every topic with a keyword in the text, rule order) and `primary_tag`.

    Where `df` has the counts of `hits` already, the texts are not read again and the counts stay.
    """
    counted, hits = hits is not None, hits or Hits(df, _words(rules), text)
    found = F.array_compact(F.array(*[
        F.when(hits.any(kws), F.lit(topic)) for topic, kws in rules.items()
    ]))
    tagged = df.withColumn("tags", found) if counted else hits.df.withColumn("tags", found).drop("_n")
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit(default)))
    return tagged.withColumn("tags", tags).withColumn("primary_tag", F.element_at("tags", 1))


def context_score(df: DataFrame, contexts: Mapping[str, tuple[Sequence[str], Sequence[str], float]],
                  text: str = "text", base: str = "base_score", topic: str = "primary_tag",
                  out: str = "score", hits: Hits | None = None) -> DataFrame:
    """base + step * (bullish hits - bearish hits) of the row's topic, clipped to ±1, 4 decimals. `hits` as in `tag_topics`."""
    counted, hits = hits is not None, hits or Hits(df, _context_words(contexts), text)
    adj = F.lit(0.0)
    for name, (bull, bear, step) in contexts.items():
        net = hits.matched(bull) - hits.matched(bear)
        adj = F.when(F.col(topic) == name, net * step).otherwise(adj)
    score = F.round(clip(F.col(base) + adj, -1, 1), 4)
    return df.withColumn(out, score) if counted else hits.df.withColumn(out, score).drop("_n")


def tag_and_score(df: DataFrame, rules: Rules, contexts: Mapping[str, tuple[Sequence[str], Sequence[str], float]], text: str = "text") -> DataFrame:
    """`tag_topics` and `context_score` on one reading of the texts: their keywords are counted together."""
    hits = Hits(df, [*_words(rules), *_context_words(contexts)], text)
    return context_score(tag_topics(hits.df, rules, text, hits=hits), contexts, text, hits=hits).drop("_n")


def sentiment_label(score: str | Column, cut: float = 0.05) -> Column:
    return ladder(score, [(">=", cut, "Positive"), ("<=", -cut, "Negative")], "Neutral")


def sentiment_by_topic(df: DataFrame, topics: Sequence[str], score: str = "score") -> DataFrame:
    """Mean score per tag (a row counts under each of its tags); topics without rows get the
    overall mean. One aggregation with a conditional mean per topic, no explode."""
    aggs = [F.avg(score).alias("_all")]
    for t in topics:
        has = F.array_contains("tags", t)
        aggs += [F.avg(F.when(has, F.col(score))).alias(f"_m_{t}"), F.count_if(has).alias(f"_n_{t}")]
    one = df.agg(*aggs)
    cells = [
        F.struct(F.lit(t).alias("topic"), F.coalesce(F.col(f"_m_{t}"), F.col("_all")).alias("score"),
                 F.col(f"_n_{t}").alias("n"))
        for t in topics
    ]
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def sentiment_daily(df: DataFrame, topics: Sequence[str], score: str = "score", date: str = "date") -> DataFrame:
    """(date, one column per topic): mean score of the day's rows with that tag, else of all its rows. One row per day and task
    is shuffled."""
    means = [F.avg(F.when(F.array_contains("tags", t), F.col(score))) for t in topics]
    return df.groupBy(date).agg(*[F.coalesce(m, F.avg(score)).alias(t) for t, m in zip(topics, means)])


def topic_hits_daily(df: DataFrame, rules: Rules, text: str = "text", date: str = "date",
                     word_boundary: bool = False) -> DataFrame:
    """(date, topic, hits): keyword occurrences per day, all topics for each day.

    Texts are counted row by row and summed on the map side; the shuffle carries one row per day
    and task.
    """
    topics = list(rules)
    hits = Hits(df.select(date, text), _words(rules), text, word_boundary)
    sums = hits.df.groupBy(date).agg(*[F.sum(hits.total(rules[k])).alias(k) for k in topics])
    cells = [F.struct(F.lit(k).alias("topic"), F.col(k).alias("hits")) for k in topics]
    return sums.select(date, F.explode(F.array(*cells)).alias("_c")).select(date, "_c.*")


def theme_counts(df: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """(theme, n): number of keyword matches over all texts."""
    hits = Hits(df.select(text), _words(rules), text)
    one = hits.df.agg(*[F.sum(hits.matched(kws)).alias(k) for k, kws in rules.items()])
    cells = [F.struct(F.lit(k).alias("theme"), F.col(k).alias("n")) for k in rules]
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def narrative_scores(hits: DataFrame) -> DataFrame:
    """7/14/30-row means per topic and the 7-row mean scaled by the day's largest (0-100)."""
    k = {"by": "topic", "min_periods": 1}
    means = hits.withColumns({f"s{n}": rolling(F.avg, "hits", n, **k) for n in (7, 14, 30)})
    top = F.max("s7").over(Window.partitionBy("date"))
    norm = F.coalesce(F.try_divide(F.col("s7"), top) * 100.0, F.lit(0.0))
    return means.withColumn("normalised", clip(norm, 0, 100))


def narrative_momentum(scores: DataFrame, k: int = 7) -> DataFrame:
    return scores.withColumn("momentum", pct_change("normalised", k, by="topic") * 100.0)


def narrative_status(df: DataFrame, min_days: int = 7) -> DataFrame:
    """Status of each topic and day; before `min_days` rows only the score decides."""
    days = F.row_number().over(Window.partitionBy("topic").orderBy("date"))
    s, m = F.col("normalised"), F.col("momentum")
    short = F.when(s >= 60, "DOMINANT").when(s > 20, "ACTIVE").otherwise("NEUTRAL")
    full = (
        F.when(m.isNull(), "NEUTRAL").when(s >= 60, "DOMINANT")
        .when((m >= 20) & (s > 10), "EMERGING").when((m <= -20) & (s > 5), "FADING")
        .when(s > 20, "ACTIVE").otherwise("NEUTRAL")
    )
    return df.withColumn("_d", days).withColumn(
        "status", F.when(F.col("_d") < min_days, short).otherwise(full)).drop("_d")


def narrative_asset_impact(status: DataFrame, impact: Mapping[str, Sequence[int]] = NARRATIVE_IMPACT,
                           assets: Sequence[str] = IMPACT_ASSETS, drivers: int = 3) -> DataFrame:
    """Bull, bear and net weight of the active narratives per day and asset."""
    spark = status.sparkSession
    rows = [(t, a, s) for t, signs in impact.items() for a, s in zip(assets, signs)]
    table = spark.createDataFrame(rows, "topic string, asset string, sign int")  # topics x assets
    active = status.filter(F.col("status").isin("DOMINANT", "EMERGING", "ACTIVE") & (F.col("normalised") >= 10))
    j = active.join(F.broadcast(table), "topic")
    weight = F.col("normalised") / 100.0
    driver = F.when(F.col("sign") != 0, F.struct(
        F.col("topic"), F.concat(F.when(F.col("sign") > 0, "+").otherwise("-"), F.col("topic")).alias("d")))
    agg = j.groupBy("date", "asset").agg(
        F.sum(F.when(F.col("sign") > 0, weight).otherwise(0.0)).alias("bull"),
        F.sum(F.when(F.col("sign") < 0, weight).otherwise(0.0)).alias("bear"),
        F.array_sort(F.collect_list(driver)).alias("_d"),  # at most one entry per topic
    )
    net = F.col("bull") - F.col("bear")
    return agg.withColumns({
        "net": net,
        "signal": ladder(net, [(">", 0.3, "NARRATIVE_BULLISH"), ("<", -0.3, "NARRATIVE_BEARISH")],
                         "NARRATIVE_NEUTRAL"),
        "drivers": F.array_join(F.transform(F.slice("_d", 1, drivers), lambda x: x.d), ","),
    }).drop("_d")


def status_shift_alerts(status: DataFrame, transitions=ALERT_TRANSITIONS) -> DataFrame:
    """Rows whose (previous, current) status pair is in the transition table."""
    prev = F.coalesce(lag("status", by="topic"), F.lit("NEUTRAL"))
    t = status.sparkSession.createDataFrame(transitions, "prev_status string, status string, alert string")
    moved = status.withColumn("prev_status", prev)
    return moved.join(F.broadcast(t), ["prev_status", "status"])  # seven transitions


def staleness_weight(age_days: str | Column) -> Column:
    return ladder(age_days, STALENESS, 0.10, on_null=0.75)


def tier_weight(tier: str | Column) -> Column:
    t = col(tier)
    out = F.lit(None).cast("double")
    for k, v in TIER_WEIGHTS.items():
        out = F.when(t == k, F.lit(v)).otherwise(out)
    return out


def tiered_score(articles: DataFrame, assets: Sequence[str], general_assets: Sequence[str] = ("SP500", "NIFTY"),
                 score: str = "base_score", default: str = "General") -> DataFrame:
    """Weighted mean score per asset, per tier and overall.

    Untagged articles count for the broad equity assets, in tier 3 for all assets. Tier 3 carries
    no staleness. One pass with conditional sums; articles are not multiplied by assets.
    """
    stale = F.when(F.col("tier") == 3, F.lit(1.0)).otherwise(staleness_weight("age_days"))
    a = articles.withColumn("_w", tier_weight("tier") * stale)
    general = F.array_contains("tags", default)
    aggs = []
    for i, asset in enumerate(assets):
        broad = general if asset in general_assets else general & (F.col("tier") == 3)
        hit = F.array_contains("tags", asset) | broad
        for t in (1, 2, 3, 0):
            use = hit if t == 0 else hit & (F.col("tier") == t)
            aggs += [
                F.sum(F.when(use, F.col(score) * F.col("_w"))).alias(f"_s{i}_{t}"),
                F.sum(F.when(use, F.col("_w"))).alias(f"_w{i}_{t}"),
                F.count_if(use).alias(f"_n{i}_{t}"),
            ]
    one = a.agg(*aggs)

    def mean(i: int, t: int) -> Column:
        return F.round(F.try_divide(F.col(f"_s{i}_{t}"), F.col(f"_w{i}_{t}")), 4)

    cells = []
    for i, asset in enumerate(assets):
        parts = [F.lit(asset).alias("asset")]
        for t in (1, 2, 3):
            parts += [mean(i, t).alias(f"tier{t}_score"), F.col(f"_n{i}_{t}").alias(f"tier{t}_count")]
        parts += [F.coalesce(mean(i, 0), F.lit(0.0)).alias("weighted_score"),
                  F.col(f"_n{i}_0").alias("total_count")]
        cells.append(F.struct(*parts))
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def crowded_flag(n: str = "total_count", score: str = "weighted_score", cut: float = 0.80) -> Column:
    s = F.col(score)
    return (
        F.when((F.col(n) >= 3) & (F.abs(s) >= cut) & (s > 0), "CROWDED_BULLISH")
        .when((F.col(n) >= 3) & (F.abs(s) >= cut), "CROWDED_BEARISH")
        .otherwise("NO")
    )


def classify_events(df: DataFrame, rules: Mapping[str, tuple[Sequence[str], Sequence[str], Sequence[str]]],
                    keep: Sequence[str] = ("doc_id", "date"), text: str = "text") -> DataFrame:
    """One row per document and matched event type with its direction; ties are negative."""
    hits = Hits(df.select(*keep, text), [k for lists in rules.values() for kws in lists for k in kws], text)
    cells = []
    for event, (kws, pos, neg) in rules.items():
        p, n = hits.matched(pos), hits.matched(neg)
        way = F.when(p > n, "POSITIVE").when((n > p) | (n > 0), "NEGATIVE").otherwise("NEUTRAL")
        cells.append(F.when(hits.any(kws), F.struct(F.lit(event).alias("event"), way.alias("direction"))))
    found = hits.df.select(*keep, F.explode(F.array_compact(F.array(*cells))).alias("_e"))
    return found.select(*keep, "_e.*")


CONFIDENCE_STEPS = [("<=", 0, 0.0), ("<=", 1, 0.40), ("<=", 3, 0.65)]


def event_summary(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, majority direction (negative > positive > neutral on ties) and confidence."""
    is_ = {d: F.count_if(F.col("direction") == d) for d in ("NEGATIVE", "POSITIVE", "NEUTRAL")}
    votes = classified.groupBy(*by, "event").agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(f"_{d}") for d, c in is_.items()])
    neg, pos, neu = (F.col(f"_{d}") for d in is_)
    way = (F.when((neg >= pos) & (neg >= neu), "NEGATIVE").when(pos >= neu, "POSITIVE").otherwise("NEUTRAL"))
    out = votes.withColumns({"direction": way, "confidence": ladder("n", CONFIDENCE_STEPS, 0.85)})
    return out.select(*by, "event", "n", "direction", "confidence")


def event_impact(summary: DataFrame, impacts: DataFrame) -> DataFrame:
    """Per event and asset: impact of the direction times confidence; neutral is half the average.

    `impacts(event, asset, pos, neg)` is a rule table of any size (`sources.readers.read_impacts`).
    """
    j = summary.join(impacts, "event")
    raw = (
        F.when(F.col("direction") == "POSITIVE", F.col("pos"))
        .when(F.col("direction") == "NEGATIVE", F.col("neg"))
        .otherwise((F.col("pos") + F.col("neg")) / 2.0 * 0.5)
    )
    return j.withColumn("impact", F.round(raw * F.col("confidence"), 4))


def primary_event(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Event with the largest count; the alphabetically first wins a tie."""
    picked = summary.groupBy(*by).agg(
        F.min(F.struct((-F.col("n")).alias("k"), "event", "direction", "confidence")).alias("_m"))
    return picked.select(*by, "_m.event", "_m.direction", "_m.confidence")


def high_impact(impacts: DataFrame, confidence: float = 0.65, size: float = 0.10) -> DataFrame:
    """Events with enough confidence and one asset impact of at least `size`."""
    return (
        impacts.filter(F.col("confidence") >= confidence)
        .groupBy("event", "direction", "confidence")
        .agg(F.max(F.abs("impact")).alias("max_impact"))
        .filter(F.col("max_impact") >= size)
    )
