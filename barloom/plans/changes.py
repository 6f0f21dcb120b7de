"""Change detection and streaming (CH, SM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import lag
from barloom.functions.rules import NARRATIVES
from barloom.operators import changes as C
from barloom.operators.regimes import vix_trend_regime
from barloom.operators.signals import momentum_score, score_to_signal
from barloom.plans import views as V
from barloom.plans.registry import query
from barloom.plans.text import LOW, TOPICS, occ_sql
from barloom.plans.views import O, SIG, rnd, roll
from barloom.session import work_dir
from barloom.streaming import streams as S

MOM = V.BARS + ", " + V.mom_sql("bars")


def _signals(spark, sf):
    m = momentum_score(V.bars(spark, sf).select("symbol", "date", "close"))
    return m.withColumn("signal", score_to_signal("score"))


@query("ch_1_signal_change", f"""WITH {MOM}, s AS (SELECT symbol, date, {SIG} AS signal FROM mom), l AS (SELECT *, lag(signal) {O} AS prev_label FROM s)
  SELECT symbol, date, prev_label, signal FROM l WHERE prev_label IS NOT NULL AND prev_label <> signal""")
def signal_change(spark, sf):
    return C.label_changes(_signals(spark, sf), "signal").select("symbol", "date", "prev_label", "signal")


@query("ch_1_regime_shift", f"""WITH {V.WIN}, m AS (SELECT date, p5 / 12500.0 AS vix, p2, {roll('avg', 'p2', 200, by=None)} AS ma FROM win),
  r AS (SELECT date, CASE WHEN vix > 30 THEN 'Crisis' WHEN vix > 20 AND NOT p2 > ma THEN 'Bear Market' WHEN vix <= 20 AND p2 > ma THEN 'Bull Market' ELSE 'Sideways' END AS regime FROM m WHERE ma IS NOT NULL),
  l AS (SELECT *, lag(regime) OVER (ORDER BY date) AS prev_label FROM r) SELECT date, prev_label, regime FROM l WHERE prev_label IS NOT NULL AND prev_label <> regime""")
def regime_shift(spark, sf):
    p = V.wide_inner(spark, sf).withColumn("vix", F.col("p5") / 12500.0)
    r = vix_trend_regime(p, "vix", "p2").select("date", "regime")
    return C.label_changes(r, "regime", by=()).select("date", "prev_label", "regime")


def _cross_sql(src: str, value: str, rules) -> str:
    cond = {"up": "{v} > {x} AND prev <= {x}", "down": "{v} < {x} AND prev >= {x}", "up_to": "{v} >= {x} AND prev < {x}"}
    case = "CASE " + " ".join(f"WHEN {cond[way].format(v=value, x=x)} THEN '{n}'" for n, way, x in rules) + " END"
    return f"SELECT date, {case} AS alert FROM {src}"


@query("ch_2_threshold_cross_vix", f"WITH {V.WIDE}, v AS (SELECT date, p5 / 12500.0 AS vix, lag(p5) OVER (ORDER BY date) / 12500.0 AS prev FROM wide WHERE p5 IS NOT NULL), a AS ({_cross_sql('v', 'vix', C.VIX_RULES)}) SELECT date, alert FROM a WHERE alert IS NOT NULL")
def threshold_cross_vix(spark, sf):
    v = V.bars(spark, sf).filter("symbol = '5-LOW'").select("date", (F.col("close") / 12500.0).alias("vix"))
    return C.threshold_cross(v, "vix", C.VIX_RULES).select("date", "alert")


@query("ch_2_threshold_cross_sentiment", f"WITH {V.HEADLINES}, d AS (SELECT date, sum(base_score) / 5 AS s FROM headlines GROUP BY 1), v AS (SELECT *, lag(s) OVER (ORDER BY date) AS prev FROM d), a AS ({_cross_sql('v', 's', C.SENTIMENT_RULES)}) SELECT date, alert FROM a WHERE alert IS NOT NULL")
def threshold_cross_sentiment(spark, sf):
    d = V.headlines(spark, sf).groupBy("date").agg((F.sum("base_score") / 5).alias("s"))
    return C.threshold_cross(d, "s", C.SENTIMENT_RULES).select("date", "alert")


@query("ch_2_threshold_cross_curve", f"WITH {V.MACRO}, v AS (SELECT date, y10 - y2 AS s, lag(y10 - y2) OVER (ORDER BY date) AS prev FROM macro), a AS ({_cross_sql('v', 's', C.CURVE_RULES)}) SELECT date, alert FROM a WHERE alert IS NOT NULL")
def threshold_cross_curve(spark, sf):
    m = V.macro(spark, sf).select("date", (F.col("y10") - F.col("y2")).alias("s"))
    return C.threshold_cross(m, "s", C.CURVE_RULES).select("date", "alert")


@query("ch_3_daily_snapshot", f"WITH {MOM}, l AS (SELECT *, {SIG} AS signal FROM mom) SELECT " + ", ".join(
    f"max(date) FILTER (symbol = '{s}') AS {p}_date, arg_max(close, date) FILTER (symbol = '{s}') AS {p}_close, arg_max(signal, date) FILTER (symbol = '{s}') AS {p}_signal" for s, p in V.SYMBOLS.items()) + " FROM l")
def daily_snapshot(spark, sf):
    return C.daily_snapshot(_signals(spark, sf), V.SYMBOLS, ["close", "signal"])


# ------------------------------------------------------------------------- streaming


def _tick_stream(spark, sf):
    e = S.read_stream(spark, f"{sf}/events.parquet")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("id"))


# a window is emitted once the watermark (latest tick minus one hour) has passed its end
SBARS = V.TICKS + """, sb AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, CAST(count(*) AS BIGINT) AS volume
  FROM ticks GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM ticks) - INTERVAL 1 HOUR)"""


@query("sm_1_stream_bars", f"WITH {SBARS} SELECT symbol, day, open, high, low, close, volume FROM sb")
def stream_bars(spark, sf):
    out = work_dir(spark, "stream-bars")
    bars = S.stream_bars(_tick_stream(spark, sf))
    S.run_to_parquet(bars, out, work_dir(spark, "stream-bars-cp"))
    b = spark.read.parquet(out)
    return b.select("symbol", S.utc_wall(F.col("w.start")).cast("date").alias("day"), "open", "high", "low", "close", "volume")


@query("sm_2_stream_alerts", f"""WITH {SBARS}, l AS (SELECT symbol, day, CASE WHEN close > 30 THEN 'HIGH' ELSE 'LOW' END AS label, lag(CASE WHEN close > 30 THEN 'HIGH' ELSE 'LOW' END) OVER (PARTITION BY symbol ORDER BY day) AS prev_label FROM sb)
  SELECT symbol, day, prev_label, label FROM l WHERE prev_label IS NOT NULL AND prev_label <> label""")
def stream_alerts(spark, sf):
    S.use_rocksdb(spark)
    out = work_dir(spark, "stream-alerts")
    alerts = S.stream_alerts(S.stream_bars(_tick_stream(spark, sf)), F.when(F.col("close") > 30, "HIGH").otherwise("LOW"))
    S.run_to_parquet(alerts, out, work_dir(spark, "stream-alerts-cp"))
    a = spark.read.parquet(out)
    return a.select("symbol", S.utc_wall(F.timestamp_micros("at")).cast("date").alias("day"), "prev_label", "label")


@query("sm_2_ordered_alerts", """WITH u AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts, max(CASE WHEN value > 20 THEN 'HIGH' ELSE 'LOW' END) AS label FROM events
   WHERE epoch_us(ts) <= (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 FROM events) GROUP BY 1, 2),
  l AS (SELECT *, lag(label) OVER (PARTITION BY symbol ORDER BY ts) AS prev_label FROM u)
  SELECT symbol, epoch_us(ts) AS at, prev_label, label FROM l WHERE prev_label <> label""")
def stream_ordered_alerts(spark, sf):
    S.use_rocksdb(spark)
    e = S.read_stream(spark, f"{sf}/events.parquet").select("user_id", "ts", "value")
    alerts = S.stream_ordered_alerts(e, F.when(F.col("value") > 20, "HIGH").otherwise("LOW"), symbol="user_id")
    out = work_dir(spark, "ordered-alerts")
    S.run_to_parquet(alerts, out, work_dir(spark, "ordered-alerts-cp"))
    return spark.read.parquet(out).filter("NOT late").drop("late")


@query("sm_3_stream_topic_counts", f"""WITH {LOW}, d AS (SELECT date, {', '.join(f'sum({occ_sql(k)}) AS {n}' for n, k in TOPICS.items())} FROM low GROUP BY 1),
  ws AS (SELECT DISTINCT d.date + CAST(o AS INTEGER) AS window_end FROM d, generate_series(1, 7) g(o)), mx AS (SELECT max(date) - 1 AS wm FROM d),
  x AS (SELECT window_end, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in TOPICS)} FROM ws JOIN d ON d.date >= window_end - 7 AND d.date < window_end, mx WHERE window_end <= wm GROUP BY 1)
  """ + " UNION ALL ".join(f"SELECT window_end, '{n}' AS topic, {n} AS hits FROM x" for n in TOPICS))
def stream_topic_counts(spark, sf):
    d = S.read_stream(spark, f"{sf}/documents.parquet")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    h = d.select("doc_id", "text", day.cast("timestamp_ntz").alias("ts"))
    out = work_dir(spark, "stream-topics")
    S.run_to_parquet(S.stream_topic_counts(h, TOPICS), out, work_dir(spark, "stream-topics-cp"))
    return spark.read.parquet(out).select(S.utc_wall(F.col("w.end")).cast("date").alias("window_end"), "topic", "hits")


@query("sm_4_stream_upsert", """WITH c AS (SELECT 'E' || CAST(o_custkey % 50 AS VARCHAR) AS event, CAST(o_orderdate AS DATE) AS date, o_orderkey AS id, o_totalprice AS value FROM orders)
  SELECT event, date, id, value FROM c QUALIFY row_number() OVER (PARTITION BY event, date ORDER BY id) = 1""")
def stream_upsert(spark, sf):
    o = S.read_stream(spark, f"{sf}/orders.parquet")
    e = o.select(F.concat(F.lit("E"), (F.col("o_custkey") % 50).cast("string")).alias("event"), F.col("o_orderdate").cast("date").alias("date"),
                 F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    e = e.withColumn("year", F.year("date"))
    path = work_dir(spark, "stream-upsert")
    for run in range(2):  # the second run replays the source into the same table
        q = S.stream_upsert(e, path, ["event", "date", "year"], [F.col("id")], work_dir(spark, f"stream-upsert-cp{run}"), "year")
        q.awaitTermination()
    return spark.read.parquet(path).select("event", "date", "id", "value")
