"""File readers and ingest cleaning (SC operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalar import no_nan
from barloom.sources import schema as S


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _typed(schema: T.StructType) -> list[Column]:
    """Cast text to the schema; a value that does not parse becomes missing."""
    out = []
    for f in schema:
        value = F.trim(F.col(f.name)).try_cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            value = no_nan(value)
        out.append(value.alias(f.name))
    return out


#: Header names that stand for a column of the schema (price files of some exports head their dates "Price").
ALIASES = {"date": ("date", "datetime", "price")}


def _raw_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, fill: dict[str, Column]) -> DataFrame:
    """Text columns of the schema, found by the lower-cased names of the header; `fill` gives those a file may lack."""
    paths = [path] if isinstance(path, str) else list(path)
    names = spark.read.csv(paths, header=True).columns
    text = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    raw = spark.read.csv(paths, schema=text, header=True, enforceSchema=False)  # other headers in further files fail
    place = {n.strip().lower(): n for n in reversed(names)}
    out, missing = [], []
    for f in schema:
        found = next((place[a] for a in ALIASES.get(f.name, (f.name,)) if a in place), None)
        if found is not None:
            out.append(raw[found].alias(f.name))
        elif f.name in fill:
            out.append(fill[f.name].alias(f.name))
        else:
            missing.append(f.name)
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the header {', '.join(names)}")
    return raw.select(*out)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, fill: dict[str, Column] | None = None) -> DataFrame:
    """CSV files read by header name, values parsed one by one instead of failing the file.

    All files of a call share one header; a missing column of the schema is an error unless `fill` gives it.
    """
    return _raw_csv(spark, path, schema, fill or {}).select(*_typed(schema))


def _bar_fill(symbol: str | None) -> dict[str, Column]:
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.\w+)*$", 1)  # one file per instrument
    return {"symbol": F.lit(symbol) if symbol else F.url_decode(name)}


def read_bars(spark: SparkSession, path: str | Sequence[str], symbol: str | None = None) -> DataFrame:
    """Bar files by header name. Without a symbol column it is the given one, else the file's name.

    Lines whose date does not parse (junk header lines) are left out; `unread_bars` counts them.
    """
    return read_csv(spark, path, S.BARS, _bar_fill(symbol)).filter(F.col("date").isNotNull())


def unread_bars(spark: SparkSession, path: str | Sequence[str], symbol: str | None = None) -> DataFrame:
    """(symbol, n): lines per symbol that `read_bars` leaves out."""
    bars = read_csv(spark, path, S.BARS, _bar_fill(symbol))
    return bars.filter(F.col("date").isNull()).groupBy("symbol").agg(F.count("*").alias("n"))


def read_series(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Macro series by header name; rows without a date or a value are dropped."""
    return read_csv(spark, path, S.SERIES).na.drop(subset=["date", "value"])


def _rows(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
    return _raw_csv(spark, path, schema, {}).na.drop()


def read_rules(spark: SparkSession, path: str, most: int = 10_000) -> dict[str, list[str]]:
    """Keyword rules from a file `topic, keyword`: topic -> keywords, topics and keywords in the order of their names."""
    found: dict[str, list[str]] = {}
    for row in _rows(spark, path, ("topic", "keyword")).distinct().sort("topic", "keyword").limit(most + 1).collect():
        found.setdefault(row.topic, []).append(row.keyword.lower())
    if sum(map(len, found.values())) > most:
        raise ValueError(f"more than {most} rules")
    return found


def read_event_rules(spark: SparkSession, path: str, most: int = 10_000) -> dict[str, tuple[list[str], list[str], list[str]]]:
    """Rules of `classify_events` from a file `event, kind, keyword`; kind: match, positive or negative."""
    found: dict[str, tuple[list[str], list[str], list[str]]] = {}
    place = {"match": 0, "positive": 1, "negative": 2}
    rows = _rows(spark, path, ("event", "kind", "keyword")).distinct().sort("event", "kind", "keyword").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    for row in rows:
        found.setdefault(row.event, ([], [], []))[place[row.kind.strip().lower()]].append(row.keyword.lower())
    return found


def read_impacts(spark: SparkSession, path: str) -> DataFrame:
    """Impacts of `event_impact` from a file `event, asset, pos, neg`."""
    schema = T.StructType([T.StructField(c, T.StringType() if c in ("event", "asset") else T.DoubleType(), True) for c in ("event", "asset", "pos", "neg")])
    return read_csv(spark, path, schema).na.drop()


def valid_bars(df: DataFrame, prices: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Coerce prices to numbers, keep close > 0, drop rows with a missing price."""
    typed = df.withColumns({c: no_nan(F.col(c).try_cast("double")) for c in prices})
    return typed.filter(F.col("close") > 0).na.drop(subset=list(prices))


def read_latest(df: DataFrame, n: int, order: str = "date", tie: Sequence[str] = ()) -> DataFrame:
    """The newest n rows: a distributed top-n, no full sort."""
    return df.orderBy(F.col(order).desc(), *tie).limit(n)


def option_chain(df: DataFrame, underlying: str, opt_types: Sequence[str] = ("CE", "PE")) -> DataFrame:
    return df.filter((F.col("underlying") == underlying) & F.col("opt_type").isin(*opt_types))


def positions_union(parts: Sequence[DataFrame], contracts: Sequence[str]) -> DataFrame:
    """Union of yearly position files, tracked contracts only."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("contract").isin(*contracts) & F.col("date").isNotNull())


def latest_available(df: DataFrame, as_of: Column, days_back: int, date: str = "date") -> DataFrame:
    """Rows of the newest non-empty weekday within `days_back` days before `as_of`."""
    bounded = df.filter(
        F.col(date).between(F.date_sub(as_of, days_back), as_of) & (F.weekday(F.col(date)) < 5)
    )
    newest = bounded.agg(F.max(date).alias(date))
    return bounded.join(newest, date, "left_semi")
