"""Aggregations, sorts, limits, set operations (AG, ST, SE)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import forward_return
from barloom.operators import aggregate as G
from barloom.operators import ranking as R
from barloom.operators.gram import block_corr
from barloom.operators.pairs import corr_matrix
from barloom.operators.text import sentiment_label
from barloom.plans import views as V
from barloom.plans.registry import query
from barloom.plans.views import rnd
from barloom.sources.readers import read_latest, table

LABEL = V.ladder_sql("base_score", [(">=", 0.05, "Positive"), ("<=", -0.05, "Negative")], "Neutral")
CORR = "covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


def _labelled(spark, sf):
    return V.headlines(spark, sf).withColumn("label", sentiment_label("base_score"))


@query("ag_1_mean_count_std", f"""WITH {V.HEADLINES} SELECT source, round(avg(base_score), 6) AS mean,
  CAST(count(base_score) AS BIGINT) AS n, round(stddev_samp(base_score), 6) AS std FROM headlines GROUP BY 1""")
def mean_count_std(spark, sf):
    out = G.mean_count_std(V.headlines(spark, sf), ["source"], "base_score")
    return out.withColumns({"mean": rnd("mean"), "std": rnd("std")})


@query("ag_2_label_share", f"""WITH {V.HEADLINES}, l AS (SELECT source, {LABEL} AS label FROM headlines)
  SELECT source, label, CAST(count(*) AS BIGINT) AS n,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS pct FROM l GROUP BY 1, 2""")
def label_share(spark, sf):
    return R.label_share(_labelled(spark, sf), "label", ["source"]).withColumn("pct", rnd("pct"))


_R = {f"p{i}": f"r{i}" for i in range(1, 6)}
_LAST60 = f"WITH {V.WRET}, t AS (SELECT * FROM wret ORDER BY date DESC LIMIT 60)"


@query("ag_3_corr_matrix", _LAST60 + " " + " UNION ALL ".join(
    f"SELECT '{_R[a]}' AS a, '{_R[b]}' AS b, round({CORR.format(x=_R[a], y=_R[b])}, 6) AS corr FROM t" for a, b in V.PAIRS))
def corr_matrix_60(spark, sf):
    last = read_latest(V.wide_returns(spark, sf), 60)
    return corr_matrix(last, [(_R[a], _R[b]) for a, b in V.PAIRS]).withColumn("corr", rnd("corr"))


# Weekly quantities of every brand and type.
MEMBERS = """per_part AS (SELECT l_partkey, CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) AS date, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
  mem AS (SELECT p_brand || '/' || p_type AS symbol, date, sum(q) AS q FROM per_part JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def _members(spark, sf):
    li = table(spark, sf, "lineitem")
    per_part = li.groupBy("l_partkey", F.trunc(F.col("l_shipdate").cast("date"), "week").alias("date")).agg(F.sum("l_quantity").alias("q"))
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("symbol"))
    return per_part.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("symbol", "date").agg(F.sum("q").alias("q"))


@query("ag_3_corr_members", f"""WITH {MEMBERS} SELECT x.symbol AS a, y.symbol AS b, CAST(count(*) AS BIGINT) AS n,
  round({CORR.format(x='x.q', y='y.q')}, 6) + 0.0 AS corr FROM mem x JOIN mem y ON x.date = y.date AND x.symbol < y.symbol GROUP BY 1, 2""")
def corr_members(spark, sf):
    return block_corr(_members(spark, sf), value="q", block=64).withColumn("corr", rnd("corr") + 0.0)


@query("ag_4_full_corr", f"WITH {V.WRET} SELECT round({CORR.format(x='r1', y='r2')}, 6) AS corr FROM wret WHERE r1 IS NOT NULL")
def full_corr(spark, sf):
    return V.wide_returns(spark, sf).agg(rnd(G.correlation("r1", "r2")).alias("corr"))


@query("ag_5_conditional_mean", f"""WITH {V.WIN}, n AS (SELECT p5 / 12500.0 > 20 AS high, lead(p2) OVER (ORDER BY date) / p2 - 1 AS nxt FROM win)
  SELECT round(avg(nxt) FILTER (high), 6) AS mean_true, round(avg(nxt) FILTER (NOT high), 6) AS mean_false,
  CAST(count(nxt) FILTER (high) AS BIGINT) AS n_true FROM n""")
def conditional_mean(spark, sf):
    w = V.wide_inner(spark, sf).withColumn("nxt", forward_return("p2", by=()))
    out = G.conditional_mean(w, "nxt", F.col("p5") / 12500.0 > 20)
    return out.withColumns({c: rnd(c) for c in ("mean_true", "mean_false")})


QS = (0.1, 0.2, 0.25, 0.5, 0.75, 0.8, 0.9)


@query("ag_6_quantiles", f"WITH {V.RETS} SELECT symbol, " + ", ".join(
    f"round(quantile_cont(ret, {q}), 6) AS q{int(q * 100)}" for q in QS) + " FROM rets WHERE ret IS NOT NULL GROUP BY 1")
def quantiles(spark, sf):
    q = V.returns(spark, sf).groupBy("symbol").agg(F.percentile("ret", F.array(*map(F.lit, QS))).alias("_q"))
    return q.select("symbol", *[rnd(F.col("_q")[i]).alias(f"q{int(v * 100)}") for i, v in enumerate(QS)])


@query("ag_7_weighted_mean", f"""WITH {V.ARTICLES} SELECT source, round(sum(base_score * tier) / sum(tier), 6) AS score FROM articles GROUP BY 1""")
def weighted_mean(spark, sf):
    a = V.articles(spark, sf)
    return a.groupBy("source").agg(rnd(G.weighted_mean("base_score", F.col("tier").cast("double"))).alias("score"))


@query("ag_8_bar_roll_up", f"""WITH {V.BARS} SELECT symbol, last_day(date) AS period, arg_min(open, date) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, CAST(count(*) AS BIGINT) AS n_bars FROM bars GROUP BY 1, 2""")
def bar_roll_up(spark, sf):
    return G.roll_up_bars(V.bars(spark, sf), F.last_day("date"))


@query("ag_9_argmax_argmin", f"""WITH {V.RETS}, y AS (SELECT symbol, year(date) AS y, round(avg(ret), 9) AS m FROM rets GROUP BY 1, 2)
  SELECT symbol, CAST(arg_max(y, m) AS INTEGER) AS best_year, CAST(arg_min(y, m) AS INTEGER) AS worst_year FROM y GROUP BY 1""")
def argmax_argmin(spark, sf):
    y = V.returns(spark, sf).groupBy("symbol", F.year("date").alias("y")).agg(F.round(F.avg("ret"), 9).alias("m"))
    return y.groupBy("symbol").agg(F.max_by("y", "m").alias("best_year"), F.min_by("y", "m").alias("worst_year"))


@query("ag_10_vote_majority", f"""WITH {V.HEADLINES}, l AS (SELECT source, {LABEL} AS label FROM headlines),
  c AS (SELECT source, label, count(*) AS n FROM l GROUP BY 1, 2)
  SELECT source, label AS majority, CAST(n AS BIGINT) AS votes FROM c
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, label) = 1""")
def vote_majority(spark, sf):
    c = _labelled(spark, sf).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("k"), "label")).alias("_m"))
    return top.select("source", F.col("_m.label").alias("majority"), (-F.col("_m.k")).alias("votes"))


@query("ag_11_pivot", f"WITH {V.BARS} SELECT last_day(date) AS month, " + ", ".join(
    f"round(avg(CASE WHEN symbol = '{s}' THEN close END), 6) AS {p}" for s, p in V.SYMBOLS.items()) + " FROM bars GROUP BY 1")
def pivot(spark, sf):
    wide = V.bars(spark, sf).groupBy(F.last_day("date").alias("month")).pivot("symbol", list(V.SYMBOLS)).agg(F.avg("close"))
    return wide.select("month", *[rnd(f"`{s}`", 6).alias(p) for s, p in V.SYMBOLS.items()])


OUTCOMES_SQL = V.BARS + """, r AS (SELECT symbol AS asset, date, h AS horizon,
   CASE h WHEN 10 THEN lead(close, 10) OVER o WHEN 30 THEN lead(close, 30) OVER o ELSE lead(close, 60) OVER o END AS f, close
   FROM bars, (VALUES (10), (30), (60)) t(h) WINDOW o AS (PARTITION BY symbol, h ORDER BY date)),
  outc AS (SELECT asset, horizon, (f / close - 1) * 100.0 AS return_pct FROM r WHERE f IS NOT NULL)"""


@query("ag_13_expectancy", f"""WITH {OUTCOMES_SQL}, g AS (SELECT asset, CAST(horizon AS INTEGER) AS horizon, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (return_pct > 0) AS BIGINT) AS wins, avg(return_pct) FILTER (return_pct > 0) AS w,
  avg(return_pct) FILTER (return_pct < 0) AS l, avg(return_pct) AS m
  FROM outc GROUP BY GROUPING SETS ((), (asset), (horizon)))
  SELECT asset, horizon, n, wins, round(w, 4) AS avg_win, round(l, 4) AS avg_loss, round(m, 4) AS avg_return,
  round(wins / n * 100.0, 4) AS win_rate, round(wins / n * coalesce(w, 0) + (1 - wins / n) * coalesce(l, 0), 4) AS expectancy FROM g""")
def expectancy(spark, sf):
    b = V.bars(spark, sf)
    hs = (10, 30, 60)
    wide = b.select(F.col("symbol").alias("asset"), *[(forward_return("close", h) * 100.0).alias(f"f{h}") for h in hs])
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("return_pct")) for h in hs])
    out = wide.select("asset", F.explode(cells).alias("c")).select("asset", "c.*").na.drop(subset=["return_pct"])
    return G.expectancy(out).withColumns(
        {c: rnd(c, 4) for c in ("avg_win", "avg_loss", "avg_return", "win_rate", "expectancy")})


@query("ag_14_product_return", f"""WITH {V.RETS} SELECT symbol, CAST(year(date) AS INTEGER) AS year, round(product(1 + ret) - 1, 4) AS ret
  FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2""")
def product_return(spark, sf):
    r = V.returns(spark, sf).na.drop(subset=["ret"])
    return r.groupBy("symbol", F.year("date").alias("year")).agg(rnd(F.product(1.0 + F.col("ret")) - 1.0, 4).alias("ret"))


@query("ag_15_period_sum", f"""WITH {V.RETS} SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, round(sum(ret), 6) AS ret
  FROM rets GROUP BY 1, 2""")
def period_sum(spark, sf):
    return V.returns(spark, sf).groupBy("symbol", F.trunc("date", "month").alias("month")).agg(rnd(F.sum("ret")).alias("ret"))


@query("ag_16_tail_stats", f"""WITH {V.RETS} SELECT symbol, round(avg(ret), 6) AS mean, round(stddev_samp(ret) * sqrt(252), 4) AS annual_vol,
  round(max(ret), 6) AS best, round(min(ret), 6) AS worst, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe FROM rets GROUP BY 1""")
def tail_stats(spark, sf):
    out = G.tail_stats(V.returns(spark, sf), "ret", ["symbol"])
    return out.withColumns({"mean": rnd("mean"), "annual_vol": rnd("annual_vol", 4), "best": rnd("best"),
                            "worst": rnd("worst"), "sharpe": rnd("sharpe")})


# ------------------------------------------------------------------------- sorts, limits, sets


@query("st_1_top_k", f"WITH {V.HEADLINES} SELECT doc_id, base_score FROM headlines ORDER BY base_score DESC, doc_id LIMIT 10")
def top_k(spark, sf):
    h = V.headlines(spark, sf).select("doc_id", "base_score")
    return R.top_k(h, [F.col("base_score").desc(), F.col("doc_id")], 10)


@query("st_1_bottom_k_per_key", f"""WITH {V.HEADLINES} SELECT source, doc_id, base_score, CAST(rn AS INTEGER) AS rn FROM
  (SELECT *, row_number() OVER (PARTITION BY source ORDER BY base_score, doc_id) AS rn FROM headlines) WHERE rn <= 5""")
def bottom_k_per_key(spark, sf):
    h = V.headlines(spark, sf).select("source", "doc_id", "base_score")
    return R.top_per_key(h, ["source"], [F.col("base_score"), F.col("doc_id")], 5)


_MONTHLY = """m AS (SELECT symbol, CAST(month(date) AS INTEGER) AS month, round(avg(ret), 9) AS ret FROM rets GROUP BY 1, 2)"""


@query("st_3_best_worst_months", f"""WITH {V.RETS}, {_MONTHLY} (SELECT symbol, month, ret, 'best' AS kind FROM m ORDER BY ret DESC, symbol, month LIMIT 3)
  UNION ALL (SELECT symbol, month, ret, 'worst' AS kind FROM m ORDER BY ret, symbol, month LIMIT 3)""")
def best_worst_months(spark, sf):
    m = V.returns(spark, sf).groupBy("symbol", F.month("date").alias("month")).agg(rnd(F.avg("ret"), 9).alias("ret"))
    best = R.top_k(m, [F.col("ret").desc(), F.col("symbol"), F.col("month")], 3).withColumn("kind", F.lit("best"))
    worst = R.top_k(m, [F.col("ret"), F.col("symbol"), F.col("month")], 3).withColumn("kind", F.lit("worst"))
    return R.union_all(best, worst)


@query("st_4_multi_key_sort", f"""WITH {V.CALENDAR} SELECT date, impact, id FROM calendar
  ORDER BY date, CASE impact WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, id""")
def multi_key_sort(spark, sf):
    rank = F.when(F.col("impact") == "HIGH", 0).when(F.col("impact") == "MEDIUM", 1).otherwise(2)
    return V.calendar(spark, sf).select("date", "impact", "id").orderBy("date", rank, "id")


@query("st_5_last_n_rows", f"""WITH {V.BARS} SELECT symbol, date, close, CAST(rn AS INTEGER) AS rn FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 20""")
def last_n_rows(spark, sf):
    return R.top_per_key(V.bars(spark, sf).select("symbol", "date", "close"), ["symbol"], [F.col("date").desc()], 20)


@query("se_1_union_all", f"""WITH {V.CALENDAR} SELECT event, date, source FROM calendar WHERE source = 'FEED'
  UNION ALL SELECT event, date, source FROM calendar WHERE source = 'CURATED'""")
def union_all(spark, sf):
    c = V.calendar(spark, sf).select("event", "date", "source")
    return R.union_all(c.filter("source = 'FEED'"), c.filter("source = 'CURATED'"))


@query("se_2_dedupe_keep_first", f"""WITH {V.CALENDAR} SELECT event, date, source, id FROM calendar
  QUALIFY row_number() OVER (PARTITION BY lower(event), date ORDER BY CASE source WHEN 'FEED' THEN 0 ELSE 1 END, id) = 1""")
def dedupe_keep_first(spark, sf):
    c = V.calendar(spark, sf).select("event", "date", "source", "id").withColumn("_k", F.lower("event"))
    prio = F.when(F.col("source") == "FEED", 0).otherwise(1)
    return R.first_per_key(c, ["_k", "date"], [prio, F.col("id")]).drop("_k")


@query("se_3_dedupe_keep_last", """SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS id,
  arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1, 2""")
def dedupe_keep_last(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return R.first_per_key(o, ["symbol", "date"], [F.col("id").desc()])


@query("se_4_intersect_keys", f"""WITH {V.BARS} SELECT date FROM bars WHERE symbol = '1-URGENT' INTERSECT
  SELECT date FROM bars WHERE symbol = '2-HIGH'""")
def intersect_keys(spark, sf):
    b = V.bars(spark, sf)
    return b.filter("symbol = '1-URGENT'").select("date").intersect(b.filter("symbol = '2-HIGH'").select("date"))
