"""File layouts, upserts, streams and portfolio rules on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import decisions as D
from barloom.operators import market as M
from barloom.operators import options as O
from barloom.operators import signals as G
from barloom.operators import text as T
from barloom.sources import readers, sinks
from barloom.streaming import streams as S


def test_bars_by_header_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,symbol,close,high,low,open,volume\n2024-01-02,A,11,12,9,10,5\n")
    r = readers.read_bars(spark, str(tmp_path / "a.csv")).collect()
    assert [(x.symbol, x.open, x.close, x.high, x.low) for x in r] == [("A", 10.0, 11.0, 12.0, 9.0)]
    (tmp_path / "b.csv").write_text("date,symbol,high,low,open,volume\n2024-01-02,A,12,9,10,5\n")
    with pytest.raises(ValueError, match="close"):
        readers.read_bars(spark, str(tmp_path / "b.csv"))


def test_one_file_per_instrument(spark, tmp_path):
    for name, close in (("GOLD", 5), ("OIL", 7)):
        (tmp_path / f"{name}.csv").write_text(f"Price,Close,High,Low,Open,Volume\nTicker,X,X,X,X,X\nDate,,,,,\n2024-01-02,{close},9,1,4,3\n")
    r = readers.read_bars(spark, str(tmp_path)).collect()
    assert sorted((x.symbol, x.date, x.open, x.close) for x in r) == [("GOLD", dt.date(2024, 1, 2), 4.0, 5.0), ("OIL", dt.date(2024, 1, 2), 4.0, 7.0)]
    assert [x.symbol for x in readers.read_bars(spark, str(tmp_path / "OIL.csv"), symbol="WTI").collect()] == ["WTI"]
    assert {(x.symbol, x.n) for x in readers.unread_bars(spark, str(tmp_path)).collect()} == {("GOLD", 2), ("OIL", 2)}


def test_rule_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("event,kind,keyword\nSTRIKE,match,Strike\nSTRIKE,negative,walkout\nDEAL,match,deal\nDEAL,positive,signed\n")
    (tmp_path / "i.csv").write_text("event,asset,pos,neg\nDEAL,OIL,0.5,-0.5\n")
    rules = readers.read_event_rules(spark, str(tmp_path / "r.csv"))
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), "A deal was signed"), (2, dt.date(2024, 1, 1), "strike: walkout")], "doc_id long, date date, text string")
    assert {(x.event, x.direction) for x in T.classify_events(df, rules).collect()} == {("DEAL", "POSITIVE"), ("STRIKE", "NEGATIVE")}
    out = T.event_impact(T.event_summary(T.classify_events(df, rules)), readers.read_impacts(spark, str(tmp_path / "i.csv")))
    assert [(x.asset, x.impact) for x in out.collect()] == [("OIL", 0.2)]


def test_whole_words(spark):
    df = spark.createDataFrame([("a@b @ war warfare, war",)], "text string")
    h = T.Hits(df, ["@", "war"], word_boundary=True)
    assert h.df.select(h.count("@"), h.count("war")).first()[:] == (1, 2)


def test_stream_reads_its_folder_only(spark, tmp_path):
    for name in ("tab", "tab_old", "tab__merge"):
        spark.range(3).write.parquet(str(tmp_path / name))
    out = str(tmp_path / "out")
    S.run_to_parquet(S.read_stream(spark, str(tmp_path / "tab")), out, str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 3


@pytest.mark.parametrize("batches", [[[(1, 5), (2, 9)]], [[(2, 9)], [(1, 5)]], [[(1, 5)], [(2, 9)]]])
def test_stream_upsert_does_not_depend_on_batches(spark, tmp_path, batches):
    src, path = tmp_path / "src", str(tmp_path / "t")
    for k, rows in enumerate(batches):
        spark.createDataFrame([("A", dt.date(2024, 1, 1), i, v) for i, v in rows], "symbol string, day date, id int, v int").coalesce(1).write.mode("append").parquet(str(src))
        S.stream_upsert(S.read_stream(spark, str(src)), path, ["symbol", "day"], [F.col("id")], str(tmp_path / "cp"), "day").awaitTermination()
    assert [(x.id, x.v) for x in spark.read.parquet(path).collect()] == [(1, 5)]


def test_upsert_checks_columns_and_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_run_date(spark.createDataFrame([(1, "x", 1)], "date int, k string, v int"), path)
    with pytest.raises(ValueError, match="v"):
        sinks.upsert_path(spark, path, spark.createDataFrame([(1, "x")], "date int, k string"), ["date", "k"])
    sinks.upsert_path(spark, path, spark.createDataFrame([(1, "x", 2)], "date int, k string, v int"), ["date", "k"])
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_portfolio_with_missing_pairs(spark):
    schema = "symbol string, bias string, adj_position double, annual_vol double"
    corr = spark.createDataFrame([], "a string, b string, corr double")
    two = spark.createDataFrame([("A", "LONG", 20.0, 0.3), ("B", "SHORT", 20.0, 0.3)], schema)
    x, y = 0.06, 0.06
    got = D.portfolio_vol_dd(two, corr).first()
    assert abs(got.port_vol - (x * x + y * y + 2 * 0.3 * x * y) ** 0.5) < 1e-12
    with_pair = D.portfolio_vol_dd(two, spark.createDataFrame([("A", "B", 0.9)], "a string, b string, corr double")).first()
    assert abs(with_pair.port_vol - (x * x + y * y + 2 * 0.9 * x * y) ** 0.5) < 1e-12
    idle = D.portfolio_vol_dd(two.withColumn("bias", F.lit("NO TRADE")), corr).first()
    assert (idle.port_vol, idle.level) == (0.0, "NONE")


def test_default_thresholds(spark):
    t = spark.createDataFrame([(3, 0.85), (3, -0.85), (2, 0.85), (3, 0.75)], "total_count int, weighted_score double")
    assert [x[0] for x in t.select(T.crowded_flag()).collect()] == ["CROWDED_BULLISH", "CROWDED_BEARISH", "NO", "NO"]
    chain = [("e", "PE", 99.0, 6.0, 9.0), ("e", "PE", 97.0, 99.0, 9.0), ("e", "CE", 101.0, None, 4.0), ("e", "CE", 103.0, 99.0, 9.0)]
    df = spark.createDataFrame(chain, "expiry string, opt_type string, strike double, close_px double, last_px double")
    assert O.skew_ratio(df, 100.0).first().skew_ratio == 1.5
    sizing = spark.createDataFrame([("A", "LONG", 10.0), ("B", "LONG", 10.0), ("C", "LONG", 10.0)], "symbol string, bias string, position_pct double")
    corr = spark.createDataFrame([("A", "B", 0.75), ("A", "C", 0.5), ("B", "C", 0.2)], "a string, b string, corr double")
    assert {(x.symbol, x.corr_flag, x.adj_position) for x in D.corr_haircut(sizing, corr).collect()} == {("A", "HIGH_CORR_WARNING", 7.0), ("B", "HIGH_CORR_WARNING", 7.0), ("C", "DIVERSIFIED", 10.0)}


def test_sentiment_term(spark):
    df = spark.createDataFrame([("NIFTY", 0.2), ("Gold", 0.2), ("Crude", 0.2), ("SP500", None)], "asset string, sentiment double")
    got = [round(x[0], 6) for x in df.select(G.sentiment_term("sentiment")).collect()]
    assert got == [0.02, -0.015, 0.0, 0.0]


def test_history_rank_does_not_look_ahead(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day + dt.timedelta(i), float(v), 0.0) for i, v in enumerate([5, 3, 4, 9])]
    df = spark.createDataFrame(rows, "date date, f double, s double")
    first = M.futures_basis(df.limit(3), "f", "s", 0.0).sort("date").collect()
    assert [x.basis_pct for x in M.futures_basis(df, "f", "s", 0.0).sort("date").collect()][:3] == [x.basis_pct for x in first]
