"""Market views over the given tables, in Spark and as DuckDB CTEs.

All views aggregate or project the whole table. Timestamps arrive without zone and are cut to
dates, which does not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.rolling import pct_change, sma
from barloom.operators.align import align_inner, panel
from barloom.sources.readers import table

# The series of the bar view and their panel columns.
SYMBOLS = {
    "1-URGENT": "p1",
    "2-HIGH": "p2",
    "3-MEDIUM": "p3",
    "4-NOT SPECIFIED": "p4",
    "5-LOW": "p5",
}
PANEL = list(SYMBOLS.values())
PAIRS = [(a, b) for i, a in enumerate(PANEL) for b in PANEL[i + 1:]]


def rnd(x: str | Column, n: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, n)


def bars(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("date")
    ).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", "date", "close", pct_change("close").alias("ret"))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return panel(bars(spark, sf), SYMBOLS)


def wide_inner(spark: SparkSession, sf: str) -> DataFrame:
    return align_inner(wide(spark, sf), PANEL)


def wide_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned panel with one return column per series (r1 … r5)."""
    cols = {f"r{i + 1}": pct_change(p, by=()) for i, p in enumerate(PANEL)}
    return wide_inner(spark, sf).withColumns(cols)


def series_m(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        F.col("l_returnflag").alias("series_id"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"),
    ).agg(F.sum("l_quantity").alias("value"))


def macro(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly macro panel: price index, growth, two yields, policy rate."""
    li = table(spark, sf, "lineitem")
    a, n, r = (F.col("l_returnflag") == f for f in "ANR")
    return li.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).agg(
        F.avg(F.when(a, F.col("l_quantity"))).alias("cpi_index"),
        (F.avg(F.when(n, F.col("l_quantity"))) - 25.0).alias("growth"),
        (F.avg(F.when(r, F.col("l_discount"))) * 100.0).alias("y10"),
        (F.avg(F.when(a, F.col("l_tax"))) * 100.0 + 1.0).alias("y2"),
        (F.avg(F.when(n, F.col("l_tax"))) * 100.0).alias("policy"),
    )


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts"), F.col("value").alias("price"),
                    F.col("event_id").alias("id"))


def headlines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
        "source",
        "text",
        (((F.col("doc_id") * 37) % 201 - 100) / F.lit(100.0)).alias("base_score"),
    )


def news(spark: SparkSession, sf: str) -> DataFrame:
    """The headlines dated over the days of the bar view."""
    days = F.date_add(F.lit("1992-01-01").cast("date"), ((F.col("doc_id") * 37) % 2400).cast("int"))
    return headlines(spark, sf).withColumn("date", days)


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return headlines(spark, sf).withColumns({
        "tier": (1 + F.col("doc_id") % 3).cast("int"),
        "age_days": (F.col("doc_id") % 10).cast("int"),
    })


def options(spark: SparkSession, sf: str) -> DataFrame:
    """Chain by quarter, strike and type.

    Line items are summed per part before the join, so a part that holds a large share of the rows
    reaches the shuffle as a few rows.
    """
    li = table(spark, sf, "lineitem")
    per_part = li.groupBy(
        "l_partkey", F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("expiry"),
        F.when(F.col("l_linestatus") == "F", "PE").otherwise("CE").alias("opt_type"),
    ).agg(
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    part = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("strike"))
    return per_part.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("expiry", "strike", "opt_type").agg(
        F.sum("q").alias("oi"), F.sum("n").cast("double").alias("vol"), (F.sum("p") / F.sum("n")).alias("price"))


def flows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(-1.0)
    return o.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.sum(F.col("o_totalprice") * sign).alias("net"))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    q, st = F.col("l_quantity"), F.col("l_linestatus")
    return li.groupBy(
        F.col("l_returnflag").alias("contract"),
        F.trunc(F.col("l_shipdate").cast("date"), "week").alias("date"),
    ).agg(
        F.sum(F.when(st == "O", q).otherwise(0.0)).alias("long"),
        F.sum(F.when(st == "F", q).otherwise(0.0)).alias("short"),
        F.sum(q).alias("oi"),
    )


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    prio = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("E"), (F.col("o_custkey") % 50).cast("string")).alias("event"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("c_nationkey").cast("string").alias("country"),
        F.when(prio <= 2, "HIGH").when(prio == 3, "MEDIUM").otherwise("LOW").alias("impact"),
        F.when(F.col("o_orderkey") % 2 == 0, "FEED").otherwise("CURATED").alias("source"),
        F.col("o_orderkey").alias("id"),
    )


def px(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed closes: a price path with everyday returns for backtests and fits."""
    b = bars(spark, sf)
    return b.select("symbol", "date", sma("close", 20).alias("close")).na.drop(subset=["close"])


# --------------------------------------------------------------------------- DuckDB counterparts

BARS = """bars AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
  arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""

RETS = BARS + """,
 rets AS (SELECT symbol, date, close, close / lag(close) OVER o - 1 AS ret FROM bars
  WINDOW o AS (PARTITION BY symbol ORDER BY date))"""

WIDE = BARS + ",\n wide AS (SELECT date, " + ", ".join(
    f"max(CASE WHEN symbol = '{s}' THEN close END) AS {p}" for s, p in SYMBOLS.items()
) + " FROM bars GROUP BY date)"

WIN = WIDE + ",\n win AS (SELECT * FROM wide WHERE " + " AND ".join(
    f"{p} IS NOT NULL" for p in PANEL) + ")"

WRET = WIN + ",\n wret AS (SELECT *, " + ", ".join(
    f"{p} / lag({p}) OVER (ORDER BY date) - 1 AS r{i + 1}" for i, p in enumerate(PANEL)
) + " FROM win)"

SERIES_M = """series_m AS (SELECT l_returnflag AS series_id,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)"""

MACRO = """macro AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS cpi_index,
  avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) - 25.0 AS growth,
  avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) * 100.0 AS y10,
  avg(CASE WHEN l_returnflag = 'A' THEN l_tax END) * 100.0 + 1.0 AS y2,
  avg(CASE WHEN l_returnflag = 'N' THEN l_tax END) * 100.0 AS policy
  FROM lineitem GROUP BY 1)"""

TICKS = "ticks AS (SELECT event_type AS symbol, ts, value AS price, event_id AS id FROM events)"

HEADLINES = """headlines AS (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date,
  source, text, ((doc_id * 37) % 201 - 100) / CAST(100.0 AS DOUBLE) AS base_score FROM documents)"""

NEWS = """headlines AS (SELECT doc_id, DATE '1992-01-01' + CAST((doc_id * 37) % 2400 AS INTEGER) AS date,
  source, text, ((doc_id * 37) % 201 - 100) / CAST(100.0 AS DOUBLE) AS base_score FROM documents)"""

ARTICLES = HEADLINES + """,
 articles AS (SELECT *, CAST(1 + doc_id % 3 AS INTEGER) AS tier,
  CAST(doc_id % 10 AS INTEGER) AS age_days FROM headlines)"""

OPTIONS = """options AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS expiry,
  p_size * CAST(10.0 AS DOUBLE) AS strike, CASE WHEN l_linestatus = 'F' THEN 'PE' ELSE 'CE' END AS opt_type,
  sum(l_quantity) AS oi, CAST(count(*) AS DOUBLE) AS vol, avg(l_extendedprice / l_quantity) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""

FLOWS = """flows AS (SELECT CAST(o_orderdate AS DATE) AS date,
  sum(o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END) AS net FROM orders GROUP BY 1)"""

POSITIONS = """positions AS (SELECT l_returnflag AS contract, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0.0 END) AS "long",
  sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END) AS "short",
  sum(l_quantity) AS oi FROM lineitem GROUP BY 1, 2)"""

CALENDAR = """calendar AS (SELECT 'E' || CAST(o_custkey % 50 AS VARCHAR) AS event,
  CAST(o_orderdate AS DATE) AS date, CAST(c_nationkey AS VARCHAR) AS country,
  CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 'HIGH'
       WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) = 3 THEN 'MEDIUM' ELSE 'LOW' END AS impact,
  CASE WHEN o_orderkey % 2 = 0 THEN 'FEED' ELSE 'CURATED' END AS source, o_orderkey AS id
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

O = "OVER (PARTITION BY symbol ORDER BY date)"


def w(n: int, by: str | None = "symbol", order: str = "date", skip: int = 0) -> str:
    """OVER clause of the n rows ending `skip` rows before the current one."""
    part = f"PARTITION BY {by} " if by else ""
    end = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"OVER ({part}ORDER BY {order} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {end})"


def roll(agg: str, x: str, n: int, need: int | None = None, **kw) -> str:
    over = w(n, **kw)
    return f"CASE WHEN count({x}) {over} >= {need or n} THEN {agg}({x}) {over} END"


def clip_sql(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) < {lo} THEN {lo} WHEN ({x}) > {hi} THEN {hi} ELSE ({x}) END"


def dbl(v: object) -> str:
    if isinstance(v, float):
        return f"CAST({v} AS DOUBLE)"
    return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))


def ladder_sql(x: str, steps, default, on_null=None) -> str:
    parts = [f"CASE WHEN ({x}) IS NULL THEN {dbl(on_null)}"]
    parts += [f"WHEN ({x}) {op} {cut} THEN {dbl(val)}" for op, cut, val in steps]
    return " ".join(parts) + f" ELSE {dbl(default)} END"


def map_sql(x: str, mapping, default=None) -> str:
    return "CASE " + " ".join(f"WHEN ({x}) = '{k}' THEN {dbl(v)}" for k, v in mapping.items()) + (
        f" ELSE {dbl(default)} END")


def corr_sql(x: str, y: str, n: int, by: str | None = "symbol", order: str = "date") -> str:
    over = w(n, by, order)
    cx, cy = (f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN {v} END" for v in (x, y))
    return (f"CASE WHEN count({cx}) {over} >= {n} THEN covar_samp({cx}, {cy}) {over} / "
            f"nullif(stddev_samp({cx}) {over} * stddev_samp({cy}) {over}, 0) END")


PX = BARS + f""",
 px0 AS (SELECT symbol, date, {roll('avg', 'close', 20)} AS close FROM bars),
 px AS (SELECT * FROM px0 WHERE close IS NOT NULL)"""


def mom_sql(src: str, name: str = "mom") -> str:
    """CTE with the triple moving-average score of `src(symbol, date, close)`."""
    return f"""{name}0 AS (SELECT symbol, date, close, {roll('avg', 'close', 20)} AS m20, {roll('avg', 'close', 60)} AS m60,
   {roll('avg', 'close', 200)} AS m200 FROM {src}),
 {name} AS (SELECT symbol, date, close, round(CAST(CASE WHEN close > m20 THEN 0.33 ELSE -0.33 END + CASE WHEN m20 > m60 THEN 0.33 ELSE -0.33 END
   + CASE WHEN m60 > m200 THEN 0.34 ELSE -0.34 END AS DOUBLE), 4) AS score FROM {name}0)"""


SIGNAL_STEPS = [(">=", 0.15, "Long"), ("<=", -0.15, "Short")]
SIG = ladder_sql("score", SIGNAL_STEPS, "Neutral")
SCORES = PX + ",\n " + mom_sql("px")
