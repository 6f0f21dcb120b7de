"""Text scoring over the headline view of the documents (TX)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import rules as D
from barloom.operators import ranking as R
from barloom.operators import text as T
from barloom.plans import views as V
from barloom.plans.registry import query
from barloom.plans.views import rnd

# Rules for the invented prose of the test documents: always, often, rarely and never hit.
TOPICS = {"T_COMMON": ["er", "tion"], "T_EN": ["the"], "T_AI": ["ai"], "T_LICENSE": ["license"], "T_MAIL": ["@"],
          "T_NONE": ["password"]}
TOPIC_CONTEXTS = {"T_COMMON": (["er", "the"], ["tion", "war"], 0.12), "T_EN": (["rally"], ["war", "ai"], 0.10),
                  "T_AI": (["model", "data"], ["error", "default"], 0.10)}
EVENT_RULES = {"E_COMMON": (["er", "tion"], ["er"], ["tion"]), "E_AI": (["ai"], ["model", "data"], ["war", "error"]),
               "E_LICENSE": (["license"], ["open"], ["tax"]), "E_NONE": (["password"], ["a"], ["b"])}
EVENT_IMPACTS = [("E_COMMON", "Gold", 0.20, -0.20), ("E_COMMON", "SP500", 0.15, -0.15), ("E_AI", "SP500", 0.10, -0.10),
                 ("E_AI", "Gold", 0.0, 0.05), ("E_LICENSE", "NIFTY", 0.05, -0.05), ("E_LICENSE", "Crude", -0.05, 0.10)]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(kws, t="t") -> str:
    return "(" + " OR ".join(f"contains({t}, {q(k)})" for k in kws) + ")"


def hits_sql(kws, t="t") -> str:
    return "(" + " + ".join(f"CAST(contains({t}, {q(k)}) AS INTEGER)" for k in kws) + ")"


def occ_sql(kws, t="t") -> str:
    return "(" + " + ".join(f"len(string_split({t}, {q(k)})) - 1" for k in kws) + ")"


LOW = V.HEADLINES + ", low AS (SELECT *, lower(text) AS t FROM headlines)"


def tags_sql(rules) -> str:
    found = ", ".join(f"CASE WHEN {any_sql(k)} THEN '{n}' END" for n, k in rules.items())
    return f"list_filter([{found}], lambda x: x IS NOT NULL)"


TAGGED = LOW + f""", tg AS (SELECT *, CASE WHEN len({tags_sql(TOPICS)}) > 0 THEN {tags_sql(TOPICS)} ELSE ['General'] END AS tags FROM low)"""
SCORED = TAGGED + ", sc AS (SELECT *, round(" + V.clip_sql("base_score + CASE tags[1] " + " ".join(
    f"WHEN '{n}' THEN ({hits_sql(b)} - {hits_sql(s)}) * CAST({step} AS DOUBLE)" for n, (b, s, step) in TOPIC_CONTEXTS.items()
) + " ELSE 0.0 END", -1.0, 1.0) + ", 4) AS score FROM tg)"


def _tagged(spark, sf):
    return T.tag_topics(V.headlines(spark, sf), TOPICS)


def _scored(spark, sf):
    return T.tag_and_score(V.headlines(spark, sf), TOPICS, TOPIC_CONTEXTS)


@query("tx_1_tag_topics", f"WITH {TAGGED} SELECT doc_id, array_to_string(tags, ',') AS tags, tags[1] AS primary_tag FROM tg")
def tag_topics(spark, sf):
    return _tagged(spark, sf).select("doc_id", F.array_join("tags", ",").alias("tags"), "primary_tag")


_MK = f"CASE WHEN len({tags_sql(D.MARKET_KEYWORDS)}) > 0 THEN {tags_sql(D.MARKET_KEYWORDS)} ELSE ['General'] END"


@query("tx_1_tag_markets", f"WITH {LOW} SELECT doc_id, array_to_string({_MK}, ',') AS tags FROM low")
def tag_markets(spark, sf):
    t = T.tag_topics(V.headlines(spark, sf), D.MARKET_KEYWORDS)
    return t.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("tx_2_context_score", f"WITH {SCORED} SELECT doc_id, score FROM sc")
def context_score(spark, sf):
    return _scored(spark, sf).select("doc_id", "score")


_DEF = V.clip_sql("base_score + CASE m WHEN 'General' THEN 0.0 " + " ".join(
    f"WHEN '{n}' THEN ({hits_sql(b)} - {hits_sql(s)}) * CAST({step} AS DOUBLE)" for n, (b, s, step) in D.CONTEXTS.items()
) + " ELSE 0.0 END", -1.0, 1.0)


@query("tx_2_market_context_score", f"WITH {LOW}, mk AS (SELECT *, ({_MK})[1] AS m FROM low) SELECT doc_id, m AS market, round({_DEF}, 4) AS score FROM mk")
def market_context_score(spark, sf):
    t = T.tag_and_score(V.headlines(spark, sf), D.MARKET_KEYWORDS, D.CONTEXTS)
    return t.select("doc_id", F.col("primary_tag").alias("market"), "score")


def label_sql(cut: float) -> str:
    return V.ladder_sql("score", [(">=", cut, "Positive"), ("<=", -cut, "Negative")], "Neutral")


@query("tx_3_classify_sentiment", f"WITH {SCORED} SELECT doc_id, {label_sql(0.05)} AS label05, {label_sql(0.15)} AS label15 FROM sc")
def classify_sentiment(spark, sf):
    s = _scored(spark, sf)
    return s.select("doc_id", T.sentiment_label("score", 0.05).alias("label05"), T.sentiment_label("score", 0.15).alias("label15"))


@query("tx_4_sentiment_by_topic", f"WITH {SCORED} " + " UNION ALL ".join(
    f"SELECT '{n}' AS topic, round(coalesce(avg(score) FILTER (list_contains(tags, '{n}')), avg(score)), 6) AS score, CAST(count(*) FILTER (list_contains(tags, '{n}')) AS BIGINT) AS n FROM sc" for n in TOPICS))
def sentiment_by_topic(spark, sf):
    return T.sentiment_by_topic(_scored(spark, sf), list(TOPICS)).withColumn("score", rnd("score"))


HITS = LOW + ", wide_hits AS (SELECT date, " + ", ".join(
    f"CAST(sum({occ_sql(k)}) AS BIGINT) AS {n}" for n, k in D.NARRATIVES.items()) + " FROM low GROUP BY 1), hits AS (" + " UNION ALL ".join(
    f"SELECT date, '{n}' AS topic, {n} AS hits FROM wide_hits" for n in D.NARRATIVES) + ")"


def _hits(spark, sf):
    return T.topic_hits_daily(V.headlines(spark, sf), D.NARRATIVES)


@query("tx_5_topic_hits_daily", f"WITH {HITS} SELECT date, topic, hits FROM hits")
def topic_hits_daily(spark, sf):
    return _hits(spark, sf)


@query("tx_6_theme_counts", f"WITH {LOW} " + " UNION ALL ".join(
    f"SELECT '{n}' AS theme, CAST(sum({hits_sql(k)}) AS BIGINT) AS n FROM low" for n, k in D.THEME_KEYWORDS.items()))
def theme_counts(spark, sf):
    return T.theme_counts(V.headlines(spark, sf), D.THEME_KEYWORDS)


@query("st_2_top_themes", f"WITH {LOW}, c AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS theme, CAST(sum({hits_sql(k)}) AS BIGINT) AS n FROM low" for n, k in D.THEME_KEYWORDS.items())
    + ") SELECT theme, n FROM c WHERE n > 0 ORDER BY n DESC, theme LIMIT 3")
def top_themes(spark, sf):
    c = T.theme_counts(V.headlines(spark, sf), D.THEME_KEYWORDS).filter("n > 0")
    return R.top_k(c, [F.col("n").desc(), F.col("theme")], 3)


def mean_sql(n):
    return f"avg(hits) OVER (PARTITION BY topic ORDER BY date ROWS {n - 1} PRECEDING)"


NARR = HITS + f""", m AS (SELECT date, topic, hits, {mean_sql(7)} AS s7, {mean_sql(14)} AS s14, {mean_sql(30)} AS s30 FROM hits),
  nm AS (SELECT *, coalesce(s7 / nullif(max(s7) OVER (PARTITION BY date), 0) * 100.0, 0.0) AS normalised FROM m),
  mo AS (SELECT *, (normalised / nullif(lag(normalised, 7) OVER (PARTITION BY topic ORDER BY date), 0) - 1) * 100.0 AS momentum,
   row_number() OVER (PARTITION BY topic ORDER BY date) AS d FROM nm),
  stt AS (SELECT *, CASE WHEN d < 7 THEN CASE WHEN normalised >= 60 THEN 'DOMINANT' WHEN normalised > 20 THEN 'ACTIVE' ELSE 'NEUTRAL' END
   WHEN momentum IS NULL THEN 'NEUTRAL' WHEN normalised >= 60 THEN 'DOMINANT' WHEN momentum >= 20 AND normalised > 10 THEN 'EMERGING'
   WHEN momentum <= -20 AND normalised > 5 THEN 'FADING' WHEN normalised > 20 THEN 'ACTIVE' ELSE 'NEUTRAL' END AS status FROM mo)"""


def _scores(spark, sf):
    return T.narrative_scores(_hits(spark, sf))


def _status(spark, sf):
    return T.narrative_status(T.narrative_momentum(_scores(spark, sf)))


@query("tx_7_narrative_scores", f"WITH {NARR} SELECT date, topic, round(s7, 6) AS s7, round(s14, 6) AS s14, round(s30, 6) AS s30, round(normalised, 6) AS normalised FROM nm")
def narrative_scores(spark, sf):
    return _scores(spark, sf).select("date", "topic", *[rnd(c).alias(c) for c in ("s7", "s14", "s30", "normalised")])


@query("tx_8_narrative_momentum", f"WITH {NARR} SELECT date, topic, round(momentum, 6) AS momentum FROM mo")
def narrative_momentum(spark, sf):
    return T.narrative_momentum(_scores(spark, sf)).select("date", "topic", rnd("momentum").alias("momentum"))


@query("tx_9_narrative_status", f"WITH {NARR} SELECT date, topic, status FROM stt")
def narrative_status(spark, sf):
    return _status(spark, sf).select("date", "topic", "status")


_SIGNS = ", ".join(f"('{t}', '{a}', {s})" for t, signs in D.NARRATIVE_IMPACT.items() for a, s in zip(D.IMPACT_ASSETS, signs))


@query("tx_10_narrative_asset_impact", f"""WITH {NARR}, im(topic, asset, sign) AS (VALUES {_SIGNS}),
  j AS (SELECT date, asset, stt.topic, sign, normalised / 100.0 AS wt FROM stt JOIN im ON stt.topic = im.topic
   WHERE status IN ('DOMINANT', 'EMERGING', 'ACTIVE') AND normalised >= 10),
  g AS (SELECT date, asset, sum(CASE WHEN sign > 0 THEN wt ELSE 0.0 END) AS bull, sum(CASE WHEN sign < 0 THEN wt ELSE 0.0 END) AS bear,
   coalesce(list((CASE WHEN sign > 0 THEN '+' ELSE '-' END) || topic ORDER BY topic) FILTER (sign <> 0), []) AS dr FROM j GROUP BY 1, 2)
  SELECT date, asset, round(bull, 6) AS bull, round(bear, 6) AS bear, round(bull - bear, 6) AS net,
  CASE WHEN bull - bear > 0.3 THEN 'NARRATIVE_BULLISH' WHEN bull - bear < -0.3 THEN 'NARRATIVE_BEARISH' ELSE 'NARRATIVE_NEUTRAL' END AS signal,
  array_to_string(dr[1:3], ',') AS drivers FROM g""")
def narrative_asset_impact(spark, sf):
    out = T.narrative_asset_impact(_status(spark, sf))
    return out.withColumns({c: rnd(c) for c in ("bull", "bear", "net")})


_TRANS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in D.ALERT_TRANSITIONS)


@query("tx_11_status_shift_alerts", f"""WITH {NARR}, tr(p, s, alert) AS (VALUES {_TRANS}),
  pv AS (SELECT date, topic, status, coalesce(lag(status) OVER (PARTITION BY topic ORDER BY date), 'NEUTRAL') AS prev_status FROM stt)
  SELECT date, topic, prev_status, status, alert FROM pv JOIN tr ON prev_status = p AND status = s""")
def status_shift_alerts(spark, sf):
    return T.status_shift_alerts(_status(spark, sf)).select("date", "topic", "prev_status", "status", "alert")


STALE = "CASE WHEN age_days IS NULL THEN 0.75 WHEN age_days <= 1 THEN 1.0 WHEN age_days <= 3 THEN 0.75 WHEN age_days <= 7 THEN 0.5 ELSE 0.1 END"


@query("tx_12_staleness_weight", f"WITH {V.ARTICLES} SELECT doc_id, age_days, CAST({STALE} AS DOUBLE) AS weight FROM articles")
def staleness_weight(spark, sf):
    return V.articles(spark, sf).select("doc_id", "age_days", T.staleness_weight("age_days").alias("weight"))


TIERED = V.ARTICLES + f""", al AS (SELECT *, lower(text) AS t FROM articles),
  atg AS (SELECT *, CASE WHEN len({tags_sql(D.ASSET_KEYWORDS)}) > 0 THEN {tags_sql(D.ASSET_KEYWORDS)} ELSE ['General'] END AS tags,
   CAST(CASE tier WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0.5 END AS DOUBLE) * CAST(CASE WHEN tier = 3 THEN 1.0 ELSE {STALE} END AS DOUBLE) AS wt FROM al),
  ax AS (SELECT unnest(['NIFTY', 'SP500', 'Gold', 'Silver', 'Crude']) AS asset),
  hit AS (SELECT asset, tier, base_score, wt FROM atg JOIN ax ON list_contains(tags, asset)
   OR (list_contains(tags, 'General') AND (asset IN ('SP500', 'NIFTY') OR tier = 3))),
  ts AS (SELECT ax.asset, """ + ", ".join(
    f"round(sum(base_score * wt) FILTER (tier = {t}) / sum(wt) FILTER (tier = {t}), 4) AS tier{t}_score, CAST(count(base_score) FILTER (tier = {t}) AS BIGINT) AS tier{t}_count" for t in (1, 2, 3)
) + """, coalesce(round(sum(base_score * wt) / sum(wt), 4), 0.0) AS weighted_score, CAST(count(base_score) AS BIGINT) AS total_count
   FROM ax LEFT JOIN hit ON ax.asset = hit.asset GROUP BY 1)"""


def _tiered(spark, sf):
    a = T.tag_topics(V.articles(spark, sf), D.ASSET_KEYWORDS)
    return T.tiered_score(a, list(D.IMPACT_ASSETS))


@query("tx_13_tiered_score", f"WITH {TIERED} SELECT * FROM ts")
def tiered_score(spark, sf):
    return _tiered(spark, sf)


@query("tx_14_crowded_flag", f"""WITH {TIERED} SELECT asset, CASE WHEN total_count >= 3 AND abs(weighted_score) >= 0.005 THEN
  CASE WHEN weighted_score > 0 THEN 'CROWDED_BULLISH' ELSE 'CROWDED_BEARISH' END ELSE 'NO' END AS crowded,
  coalesce(abs(tier1_score) >= 0.60, false) AS tier1_alert FROM ts""")
def crowded_flag(spark, sf):
    t = _tiered(spark, sf)
    return t.select("asset", T.crowded_flag(cut=0.005).alias("crowded"), F.coalesce(F.abs("tier1_score") >= 0.60, F.lit(False)).alias("tier1_alert"))


def _way(pos, neg):
    return f"CASE WHEN {hits_sql(pos)} > {hits_sql(neg)} THEN 'POSITIVE' WHEN {hits_sql(neg)} > 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END"


EVENTS = LOW + ", ev AS (" + " UNION ALL ".join(
    f"SELECT doc_id, date, '{e}' AS event, {_way(p, n)} AS direction FROM low WHERE {any_sql(k)}" for e, (k, p, n) in EVENT_RULES.items()
) + """), es AS (SELECT event, count(*) AS n, count(*) FILTER (direction = 'NEGATIVE') AS ng, count(*) FILTER (direction = 'POSITIVE') AS ps,
  count(*) FILTER (direction = 'NEUTRAL') AS nt FROM ev GROUP BY 1),
  sm AS (SELECT event, CAST(n AS BIGINT) AS n, CASE WHEN ng >= ps AND ng >= nt THEN 'NEGATIVE' WHEN ps >= nt THEN 'POSITIVE' ELSE 'NEUTRAL' END AS direction,
   CAST(CASE WHEN n = 0 THEN 0.0 WHEN n = 1 THEN 0.4 WHEN n <= 3 THEN 0.65 ELSE 0.85 END AS DOUBLE) AS confidence FROM es),
  ei(event, asset, pos, neg) AS (VALUES """ + ", ".join(f"('{e}', '{a}', CAST({p} AS DOUBLE), CAST({n} AS DOUBLE))" for e, a, p, n in EVENT_IMPACTS) + """),
  im AS (SELECT sm.event, asset, direction, confidence, round(CASE direction WHEN 'POSITIVE' THEN pos WHEN 'NEGATIVE' THEN neg ELSE (pos + neg) / 2.0 * 0.5 END * confidence, 4) AS impact
   FROM sm JOIN ei ON sm.event = ei.event)"""


def _events(spark, sf):
    return T.classify_events(V.headlines(spark, sf), EVENT_RULES)


def _impacts(spark, sf):
    rules = spark.createDataFrame(EVENT_IMPACTS, "event string, asset string, pos double, neg double")
    return T.event_impact(T.event_summary(_events(spark, sf)), rules)


@query("tx_15_classify_events", f"WITH {EVENTS} SELECT doc_id, date, event, direction FROM ev")
def classify_events(spark, sf):
    return _events(spark, sf)


@query("tx_16_event_summary", f"WITH {EVENTS} SELECT event, n, direction, confidence FROM sm")
def event_summary(spark, sf):
    return T.event_summary(_events(spark, sf))


@query("tx_17_event_impact", f"WITH {EVENTS} SELECT asset, round(sum(impact), 4) AS net FROM im GROUP BY 1")
def event_impact(spark, sf):
    return _impacts(spark, sf).groupBy("asset").agg(F.round(F.sum("impact"), 4).alias("net"))


@query("tx_18_primary_event", f"WITH {EVENTS} SELECT event, direction, confidence FROM sm ORDER BY n DESC, event LIMIT 1")
def primary_event(spark, sf):
    return T.primary_event(T.event_summary(_events(spark, sf)))


@query("tx_18_high_impact", f"WITH {EVENTS} SELECT event, direction, confidence, max(abs(impact)) AS max_impact FROM im WHERE confidence >= 0.65 GROUP BY 1, 2, 3 HAVING max(abs(impact)) >= 0.10")
def high_impact(spark, sf):
    return T.high_impact(_impacts(spark, sf))
