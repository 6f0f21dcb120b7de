"""Alignment and joins (AL, JN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import pct_change
from barloom.operators import align as A
from barloom.operators.options import strike_pain
from barloom.operators.pairs import pair_rows
from barloom.operators.ranking import latest_per_key
from barloom.operators.similarity import cosine, one_to_all
from barloom.operators.vintages import known_asof
from barloom.plans import views as V
from barloom.plans.registry import query
from barloom.plans.views import rnd
from barloom.sources.readers import table

P = ", ".join(V.PANEL)
SPARSE = "sparse AS (SELECT symbol, date, close AS carried FROM bars WHERE day(date) % 7 = 0)"


def _sparse(b):
    return b.filter(F.dayofmonth("date") % 7 == 0).select("symbol", "date", F.col("close").alias("carried"))


@query("al_1_align_inner", f"WITH {V.WIN} SELECT date, {P} FROM win")
def align_inner(spark, sf):
    return V.wide_inner(spark, sf)


_FILLED = ", ".join(f"last_value({p} IGNORE NULLS) OVER (ORDER BY date) AS {p}" for p in V.PANEL)


@query("al_2_align_ffill", f"""WITH {V.WIDE}, f AS (SELECT date, {_FILLED} FROM wide)
  SELECT * FROM f WHERE {' AND '.join(p + ' IS NOT NULL' for p in V.PANEL)}""")
def align_ffill(spark, sf):
    return A.align_ffill(V.wide(spark, sf), V.PANEL)


@query("al_3_asof_ffill", f"""WITH {V.BARS}, {SPARSE} SELECT b.symbol, b.date, b.close, s.carried
  FROM bars b ASOF LEFT JOIN sparse s ON b.symbol = s.symbol AND b.date >= s.date""")
def asof_ffill(spark, sf):
    b = V.bars(spark, sf)
    return A.asof_join(b.select("symbol", "date", "close"), _sparse(b), ["carried"])


# First prints count the shipments of a month's first 20 days and appear 12 days after the month, the full count after 45.
PRINTS = """daily AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
  prints AS (SELECT series_id, period, month_end + 12 AS published, early AS value FROM months UNION ALL SELECT series_id, period, month_end + 45, value FROM months)"""
MONTHS = """months AS (SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS period, last_day(CAST(date_trunc('month', date) AS DATE)) AS month_end,
  sum(q) FILTER (day(date) <= 20) AS early, sum(q) AS value FROM daily GROUP BY 1, 2, 3)"""


@query("al_3_published_asof", f"""WITH {PRINTS.replace("prints AS", MONTHS + ", prints AS")}
  SELECT d.series_id, d.date, p.value, p.period FROM daily d LEFT JOIN prints p ON p.series_id = d.series_id AND p.published <= d.date
  QUALIFY row_number() OVER (PARTITION BY d.series_id, d.date ORDER BY p.period DESC, p.published DESC) = 1""")
def published_asof(spark, sf):
    li = table(spark, sf, "lineitem")
    daily = li.groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").alias("q"))
    period = F.trunc("date", "month")
    months = daily.groupBy("series_id", period.alias("period")).agg(F.sum(F.when(F.dayofmonth("date") <= 20, F.col("q"))).alias("early"), F.sum("q").alias("value"))
    out = F.array(F.struct(F.date_add(F.last_day("period"), 12).alias("published"), F.col("early").alias("value")),
                  F.struct(F.date_add(F.last_day("period"), 45).alias("published"), F.col("value")))
    prints = months.select("series_id", "period", F.explode(out).alias("_o")).select("series_id", "period", "_o.*")
    return known_asof(daily.select("series_id", "date"), prints, ["value"], by=["series_id"], keep_period="period")


@query("al_4_asof_ffill_bfill", f"""WITH {V.BARS}, {SPARSE},
  j AS (SELECT b.symbol, b.date, s.carried FROM bars b ASOF LEFT JOIN sparse s ON b.symbol = s.symbol AND b.date >= s.date)
  SELECT j.symbol, j.date, coalesce(j.carried, f.carried) AS carried
  FROM j ASOF LEFT JOIN sparse f ON j.symbol = f.symbol AND j.date <= f.date""")
def asof_ffill_bfill(spark, sf):
    b = V.bars(spark, sf)
    return A.asof_ffill_bfill(b.select("symbol", "date"), _sparse(b), ["carried"])


DAYS = """d AS (SELECT *, lead(date) OVER o AS nxt, lead(value) OVER o AS nv FROM series_m
  WINDOW o AS (PARTITION BY series_id ORDER BY date)),
  u AS (SELECT series_id, date AS start, nxt, value, nv,
   unnest(generate_series(date, CASE WHEN nxt IS NULL THEN date ELSE nxt - 1 END, INTERVAL 1 DAY)) AS day FROM d)"""


@query("al_5_upsample_ffill", f"""WITH {V.SERIES_M}, {DAYS} SELECT series_id, CAST(day AS DATE) AS date, value FROM u""")
def upsample_ffill(spark, sf):
    return A.upsample_ffill(V.series_m(spark, sf))


@query("al_5_upsample_linear", f"""WITH {V.SERIES_M}, {DAYS} SELECT series_id, CAST(day AS DATE) AS date,
  round(CASE WHEN nxt IS NULL THEN value ELSE value + (nv - value) * (CAST(day AS DATE) - start) / (nxt - start) END, 4) AS value FROM u""")
def upsample_linear(spark, sf):
    return A.upsample_linear(V.series_m(spark, sf)).withColumn("value", rnd("value", 4))


@query("al_6_business_day_grid", f"""WITH {V.BARS}, b AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1),
  u AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
  SELECT symbol, date FROM u WHERE isodow(date) < 6""")
def business_day_grid(spark, sf):
    bounds = V.bars(spark, sf).groupBy("symbol").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return A.weekday_grid(bounds)


def _two(spark, sf):
    b = V.bars(spark, sf)
    x = b.filter("symbol = '1-URGENT'").select("date", F.col("close").alias("x"))
    y = b.filter("symbol = '2-HIGH'").select("date", F.col("close").alias("y"))
    return x, y


TWO = V.BARS + """, x AS (SELECT date, close AS x FROM bars WHERE symbol = '1-URGENT'),
  y AS (SELECT date, close AS y FROM bars WHERE symbol = '2-HIGH')"""


@query("jn_1_inner_on_date", f"WITH {TWO} SELECT date, x, y FROM x JOIN y USING (date)")
def inner_on_date(spark, sf):
    x, y = _two(spark, sf)
    return x.join(y, "date")


@query("jn_2_full_outer_on_date", f"WITH {TWO} SELECT date, x, y FROM x FULL JOIN y USING (date)")
def full_outer_on_date(spark, sf):
    x, y = _two(spark, sf)
    return x.join(y, "date", "full")


# Rows of a split of ticks.
TICK_ROWS = 1_000_000


@query("jn_3_backward_asof", f"""WITH {V.TICKS}, big AS (SELECT symbol, ts, price AS last_big FROM ticks WHERE price > 50)
  SELECT t.symbol, t.id, t.price, b.last_big FROM ticks t ASOF LEFT JOIN big b ON t.symbol = b.symbol AND t.ts >= b.ts""")
def backward_asof(spark, sf):
    t = V.ticks(spark, sf)
    big = t.filter("price > 50").select("symbol", "ts", F.col("price").alias("last_big"))
    out = A.asof_join(t, big, ["last_big"], on="ts", most_rows=TICK_ROWS)
    return out.select("symbol", "id", "price", "last_big")


@query("jn_4_forward_asof", f"""WITH {V.TICKS}, big AS (SELECT symbol, ts, price AS next_big FROM ticks WHERE price > 50)
  SELECT t.symbol, t.id, b.next_big FROM ticks t ASOF LEFT JOIN big b ON t.symbol = b.symbol AND t.ts <= b.ts""")
def forward_asof(spark, sf):
    t = V.ticks(spark, sf)
    big = t.filter("price > 50").select("symbol", "ts", F.col("price").alias("next_big"))
    out = A.asof_join(t, big, ["next_big"], on="ts", direction="forward", most_rows=TICK_ROWS)
    return out.select("symbol", "id", "next_big")


MONTHS = "m AS (SELECT DISTINCT symbol, CAST(date_trunc('month', date) AS DATE) AS date FROM bars)"


@query("jn_5_nearest_asof", f"""WITH {V.BARS}, {MONTHS},
  b AS (SELECT m.symbol, m.date, r.date AS bt, r.close AS bc FROM m ASOF LEFT JOIN bars r ON m.symbol = r.symbol AND m.date >= r.date),
  f AS (SELECT b.*, r.date AS ft, r.close AS fc FROM b ASOF LEFT JOIN bars r ON b.symbol = r.symbol AND b.date <= r.date)
  SELECT symbol, date, CASE WHEN ft IS NULL OR (bt IS NOT NULL AND date - bt <= ft - date) THEN bc ELSE fc END AS close,
   CASE WHEN ft IS NULL OR (bt IS NOT NULL AND date - bt <= ft - date) THEN bt ELSE ft END AS matched_date FROM f""")
def nearest_asof(spark, sf):
    b = V.bars(spark, sf).select("symbol", "date", "close")
    months = b.select("symbol", F.trunc("date", "month").alias("date")).distinct()
    return A.nearest_asof(months, b, ["close"])


@query("jn_6_nth_bar_after", f"""WITH {V.BARS}, {MONTHS}, r AS (SELECT m.symbol, m.date, b.date AS od, b.close,
   row_number() OVER (PARTITION BY m.symbol, m.date ORDER BY b.date) AS n FROM m JOIN bars b ON m.symbol = b.symbol AND b.date > m.date)
  SELECT m.symbol, m.date, r.od AS outcome_date, r.close AS price_after FROM m LEFT JOIN r
   ON m.symbol = r.symbol AND m.date = r.date AND r.n = 10""")
def nth_bar_after(spark, sf):
    b = V.bars(spark, sf).select("symbol", "date", "close")
    months = b.select("symbol", F.trunc("date", "month").alias("date")).distinct()
    return A.nth_bar_after(months, b, 10)


@query("jn_7_left_anti", """SELECT o_orderpriority AS symbol, CAST(count(*) AS BIGINT) AS n FROM orders
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1""")
def left_anti(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"))
    logged = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(logged, "o_orderkey", "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("jn_8_left_semi", """SELECT o_orderpriority AS symbol, CAST(count(*) AS BIGINT) AS n FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1""")
def left_semi(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("symbol"))
    c = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'")
    keep = o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return keep.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


# Liquidity sensitivity per asset, applied to the series of the bar view.
SENSITIVITY = [("1-URGENT", 1.2), ("2-HIGH", 1.5), ("3-MEDIUM", 1.0), ("4-NOT SPECIFIED", 1.0), ("5-LOW", 0.8)]


@query("jn_9_broadcast_dimension", f"""WITH {V.BARS}, dim(symbol, mult) AS (VALUES {', '.join(f"('{s}', CAST({m} AS DOUBLE))" for s, m in SENSITIVITY)})
  SELECT symbol, date, round(close * mult, 4) AS scaled FROM bars JOIN dim USING (symbol)""")
def broadcast_dimension(spark, sf):
    dim = spark.createDataFrame(SENSITIVITY, "symbol string, mult double")  # five rows
    return V.bars(spark, sf).join(F.broadcast(dim), "symbol").select(
        "symbol", "date", rnd(F.col("close") * F.col("mult"), 4).alias("scaled"))


@query("jn_10_pair_rows", f"""WITH {V.BARS} SELECT a.date, a.symbol AS a, b.symbol AS b, round(a.close / b.close, 6) AS ratio
  FROM bars a JOIN bars b ON a.date = b.date AND a.symbol < b.symbol""")
def pair_join(spark, sf):
    names = {p: s for s, p in V.SYMBOLS.items()}
    rows = pair_rows(V.wide(spark, sf), V.PAIRS, labels=names)
    return rows.select("date", "a", "b", rnd(F.col("x") / F.col("y")).alias("ratio"))


@query("jn_11_strike_vs_strike", f"""WITH {V.OPTIONS}, s AS (SELECT DISTINCT expiry, strike FROM options)
  SELECT s.expiry, s.strike, round(sum(CASE WHEN o.opt_type = 'CE' AND o.strike < s.strike THEN (s.strike - o.strike) * o.oi
    WHEN o.opt_type = 'PE' AND o.strike > s.strike THEN (o.strike - s.strike) * o.oi ELSE 0.0 END), 2) AS pain
  FROM s JOIN options o USING (expiry) GROUP BY 1, 2""")
def strike_vs_strike(spark, sf):
    return strike_pain(V.options(spark, sf)).select("expiry", "strike", rnd("pain", 2).alias("pain"))


@query("jn_12_one_to_all_similarity", """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
  s AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS v, q.v AS qv FROM embeddings e, q)
  SELECT vec_id, round(list_dot_product(v, qv) / sqrt(list_dot_product(v, v) * list_dot_product(qv, qv)), 6) AS similarity FROM s""")
def one_to_all_similarity(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return one_to_all(e, e.filter("vec_id = 0"), "v").select("vec_id", rnd("similarity").alias("similarity"))


@query("jn_13_latest_per_key", f"""WITH {V.BARS} SELECT symbol, date, close FROM bars
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""")
def latest(spark, sf):
    return latest_per_key(V.bars(spark, sf).select("symbol", "date", "close"), ["symbol"])
