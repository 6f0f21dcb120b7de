"""Sources, cleaning, sinks and simple projections (SC, SK, PR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import scalar as S
from barloom.functions.rolling import cumulative, lag
from barloom.operators.ranking import first_per_key
from barloom.plans import views as V
from barloom.plans.registry import query
from barloom.plans.views import rnd
from barloom.session import work_dir
from barloom.sources import readers, sinks, versions

BAR_COLS = "symbol, date, open, high, low, close, volume"


@query("sc_1_read_bars", f"WITH {V.BARS} SELECT {BAR_COLS} FROM bars")
def read_bars(spark, sf):
    path = work_dir(spark, "bars-csv")
    sinks.export_csv(V.bars(spark, sf), path)
    return readers.read_bars(spark, path)


@query("sc_2_read_series", f"WITH {V.SERIES_M} SELECT series_id, date, value FROM series_m")
def read_series(spark, sf):
    path = work_dir(spark, "series-csv")
    sinks.export_csv(V.series_m(spark, sf), path)
    return readers.read_series(spark, path)


@query("sc_3_valid_bars", f"""WITH {V.BARS} SELECT {BAR_COLS} FROM bars WHERE close > 0""")
def valid_bars(spark, sf):
    b = V.bars(spark, sf)
    return readers.valid_bars(b.withColumns({c: F.col(c).cast("string") for c in ("open", "high", "low", "close")}))


@query("sc_4_read_table_latest", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice
  FROM orders ORDER BY date DESC, o_orderkey LIMIT 50""")
def read_table_latest(spark, sf):
    o = readers.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    return readers.read_latest(o, 50, tie=["o_orderkey"])


@query("sc_5_option_chain", f"""WITH {V.OPTIONS} SELECT expiry, strike, opt_type, oi, vol, round(price, 6) AS price
  FROM options WHERE opt_type = 'PE'""")
def option_chain(spark, sf):
    o = V.options(spark, sf).withColumn("underlying", F.lit("INDEX"))
    return readers.option_chain(o, "INDEX", ["PE"]).select(
        "expiry", "strike", "opt_type", "oi", "vol", rnd("price").alias("price"))


@query("sc_6_positions_union", f"""WITH {V.POSITIONS} SELECT contract, date, "long", "short", oi
  FROM positions WHERE contract IN ('A', 'R')""")
def positions_union(spark, sf):
    p = V.positions(spark, sf)
    folders = []
    for name, part in (("a", F.year("date") <= 1998), ("b", F.year("date") > 1998)):
        folders.append(work_dir(spark, f"positions-{name}"))
        sinks.export_csv(p.filter(part), folders[-1])
    parts = [readers.read_csv(spark, f, readers.S.POSITIONS) for f in folders]
    return readers.positions_union(parts, ["A", "R"])


@query("sc_7_latest_available", f"""WITH {V.BARS}, c AS (SELECT * FROM bars
  WHERE date BETWEEN DATE '1999-06-09' AND DATE '1999-06-13' AND isodow(date) < 6)
  SELECT symbol, date, close FROM c WHERE date = (SELECT max(date) FROM c)""")
def latest_available(spark, sf):
    b = V.bars(spark, sf)
    return readers.latest_available(b, F.lit("1999-06-13").cast("date"), 4).select("symbol", "date", "close")


@query("sk_1_write_replace", f"WITH {V.BARS} SELECT {BAR_COLS} FROM bars")
def write_replace(spark, sf):
    path = work_dir(spark, "replace")
    versions.commit_replace(V.bars(spark, sf).filter("volume > 1"), path)
    versions.commit_replace(V.bars(spark, sf), path)
    return versions.read_version(spark, path)


@query("sk_2_write_run_date", f"WITH {V.SERIES_M} SELECT series_id, date, value FROM series_m")
def write_run_date(spark, sf):
    path = work_dir(spark, "run-date")
    s = V.series_m(spark, sf)
    versions.commit_run_date(s, path)
    versions.commit_run_date(s.filter(F.col("date") >= "1998-01-01"), path)
    return versions.read_version(spark, path).select("series_id", "date", "value")


@query("sk_3_upsert", f"""WITH {V.SERIES_M} SELECT series_id, date,
  CASE WHEN date >= DATE '1998-01-01' THEN value + 1.0 ELSE value END AS value FROM series_m""")
def upsert(spark, sf):
    path = work_dir(spark, "upsert")
    s = V.series_m(spark, sf)
    versions.commit_run_date(s, path)
    new = s.filter(F.col("date") >= "1998-01-01").withColumn("value", F.col("value") + 1.0)
    versions.commit_upsert(new, path, ["series_id", "date"])
    return versions.read_version(spark, path).select("series_id", "date", "value")


@query("sk_4_export_csv_json", f"""WITH {V.HEADLINES} SELECT doc_id, date, source, base_score FROM headlines""")
def export_csv_json(spark, sf):
    path = work_dir(spark, "json")
    sinks.export_json(V.headlines(spark, sf).select("doc_id", "date", "source", "base_score"), path)
    return spark.read.json(path, schema="doc_id long, date date, source string, base_score double")


# ------------------------------------------------------------------------------- projections


@query("pr_1_date_range", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice FROM orders
  WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'""")
def date_range(spark, sf):
    o = readers.table(spark, sf, "orders")
    day = F.col("o_orderdate")
    picked = o.filter((day >= F.expr("timestamp_ntz'1997-01-01'")) & (day < F.expr("timestamp_ntz'1998-01-01'")))
    return picked.select("o_orderkey", day.cast("date").alias("date"), "o_totalprice")


@query("pr_2_index_to_base", f"""WITH {V.BARS} SELECT symbol, date,
  round(100.0 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY date), 6) AS idx FROM bars""")
def index_to_base(spark, sf):
    first = F.first("close").over(cumulative())
    return V.bars(spark, sf).select("symbol", "date", rnd(100.0 * F.col("close") / first).alias("idx"))


@query("pr_3_spread_ratio", f"""WITH {V.WIN} SELECT date, round(p1 - p2, 6) AS spread, round(p1 / p2, 6) AS ratio FROM win""")
def spread_ratio(spark, sf):
    return V.wide_inner(spark, sf).select(
        "date", rnd(F.col("p1") - F.col("p2")).alias("spread"), rnd(S.ratio("p1", "p2")).alias("ratio"))


@query("pr_4_pct_change_label", f"""WITH {V.FLOWS}, p AS (SELECT date, net, lag(net) OVER (ORDER BY date) AS prev FROM flows)
  SELECT date, round(CASE WHEN prev = 0 THEN 0.0 ELSE (net - prev) / abs(prev) * 100.0 END, 4) AS chg FROM p""")
def pct_change_label(spark, sf):
    f = V.flows(spark, sf).withColumn("prev", lag("net", by=()))
    return f.select("date", rnd(S.change_vs_previous("net", "prev"), 4).alias("chg"))


@query("pr_5_minmax_clip", f"""WITH {V.RETS} SELECT symbol, date, {V.clip_sql('round(ret, 6)', -1.0, 1.0)} AS clipped FROM rets""")
def minmax_clip(spark, sf):
    return V.returns(spark, sf).select("symbol", "date", S.clip(rnd("ret"), -1, 1).alias("clipped"))


@query("pr_6_linear_score", f"""WITH {V.SERIES_M}, d AS (SELECT series_id, date,
  value - lag(value, 4) OVER (PARTITION BY series_id ORDER BY date) AS chg FROM series_m)
  SELECT series_id, date, round({V.clip_sql('chg / -1000.0', -1.0, 1.0)}, 6) AS drain_score FROM d""")
def linear_score(spark, sf):
    chg = F.col("value") - lag("value", 4, by="series_id")
    s = V.series_m(spark, sf).withColumn("chg", chg)
    return s.select("series_id", "date", rnd(S.linear_score("chg", -1000.0)).alias("drain_score"))


VOL_STEPS = [("<", 15.0, "COMPLACENCY"), ("<", 20.0, "NORMAL"), ("<", 30.0, "ELEVATED")]


@query("pr_7_bucket", f"""WITH {V.WIDE} SELECT date, {V.ladder_sql('p5 / 12500.0', VOL_STEPS, 'CRISIS')} AS level FROM wide""")
def bucket(spark, sf):
    return V.wide(spark, sf).select("date", S.ladder(F.col("p5") / 12500.0, VOL_STEPS, "CRISIS").alias("level"))


IMPACT_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


@query("pr_8_map_label", f"""WITH {V.CALENDAR} SELECT {V.map_sql('impact', IMPACT_RANK, 9)} AS impact_rank, CAST(count(*) AS BIGINT) AS n
  FROM calendar GROUP BY 1""")
def map_label(spark, sf):
    c = V.calendar(spark, sf)
    return c.groupBy(S.map_label("impact", IMPACT_RANK, 9).alias("impact_rank")).agg(F.count(F.lit(1)).alias("n"))


@query("pr_9_prefix_code", f"""WITH {V.CALENDAR} SELECT regexp_extract(impact || ' (' || event || ')', '^\\s*([A-Z][A-Z0-9_]*)', 1) AS code,
  CAST(count(*) AS BIGINT) AS n FROM calendar GROUP BY 1""")
def prefix_code(spark, sf):
    c = V.calendar(spark, sf)
    text = F.concat("impact", F.lit(" ("), "event", F.lit(")"))
    return c.groupBy(S.prefix_code(text).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("pr_10_period_return", f"""WITH {V.BARS} SELECT symbol,
  round((arg_max(close, date) - arg_min(close, date)) / arg_min(close, date), 6) AS period_return
  FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1""")
def period_return(spark, sf):
    b = V.bars(spark, sf).filter(F.col("date").between("1996-01-01", "1999-12-31"))
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    return b.groupBy("symbol").agg(rnd((last - first) / first).alias("period_return"))


@query("with_base_score_hook", f"""WITH {V.HEADLINES} SELECT doc_id, round(CAST(length(text) AS DOUBLE), 4) AS base_score FROM headlines""")
def with_base_score_hook(spark, sf):
    from barloom.operators.text import with_base_score

    return with_base_score(V.headlines(spark, sf), lambda s: s.str.len().astype("float64")).select("doc_id", "base_score")
