"""Streaming bars, topic counts, alerts and idempotent upserts (SM).

Times arrive without zone; a watermark needs an instant, so they are read as UTC, whatever the
session zone is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import TimestampNTZType

from barloom.operators.ranking import first_per_key
from barloom.operators.text import Hits
from barloom.sources import sinks


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream, under the schema of the files present.

    `path` may be one file or a folder; the source itself wants a folder, so one file is its parent with a name filter.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = path.rstrip("/")
    if sinks.is_folder(spark, path):
        return reader.parquet(path)
    parent, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", re.sub(r"([\\*?\[\]{}])", r"\\\1", name)).parquet(parent or ".")


EPOCH, EPOCH_WALL = "TIMESTAMP'1970-01-01 00:00:00Z'", "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def utc_instant(wall: Column) -> Column:
    """Zone-less time -> the instant with that wall clock in UTC."""
    return F.expr(EPOCH) + (wall - F.expr(EPOCH_WALL))


def utc_wall(instant: Column) -> Column:
    """Instant -> zone-less UTC wall clock."""
    return F.expr(EPOCH_WALL) + (instant - F.expr(EPOCH))


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        df = df.withColumn(ts, utc_instant(F.col(ts)))
    return df.withWatermark(ts, delay)


def stream_bars(ticks: DataFrame, size: str = "1 day", delay: str = "1 hour", symbol: str = "symbol",
                ts: str = "ts", price: str = "price", tie: str = "id") -> DataFrame:
    """Tumbling OHLCV bars. Ticks are combined on the map side, so a busy symbol shuffles one
    partial bar per task and window; ticks later than the watermark are dropped."""
    order = F.struct(ts, tie)
    return (
        with_event_time(ticks, ts, delay)
        .groupBy(symbol, F.window(ts, size).alias("w"))
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("volume"))
        .select(symbol, "w", "open", "high", "low", "close", "volume")
    )


def stream_topic_counts(headlines: DataFrame, rules: Mapping[str, Sequence[str]], days: int = 7,
                        delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """Keyword occurrences per topic in sliding windows of `days` days, one per day."""
    topics = list(rules)
    hits = Hits(headlines, [k for kws in rules.values() for k in kws])
    timed = with_event_time(hits.df, ts, delay)
    sums = timed.groupBy(F.window(ts, f"{days} days", "1 day").alias("w")).agg(
        *[F.sum(hits.total(rules[k])).alias(k) for k in topics])
    cells = [F.struct(F.lit(k).alias("topic"), F.col(k).alias("hits")) for k in topics]
    return sums.select("w", F.explode(F.array(*cells)).alias("_c")).select("w", "_c.*")


class _LabelChange(StatefulProcessor):
    """Keeps the last label of a key and emits a row whenever it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "label string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one row per key and closed window: the batch of a key is small
        batch = pd.concat(list(rows)).sort_values("at")
        label, at = self.last.get() if self.last.exists() else (None, None)
        out = []
        for row in batch.itertuples(index=False):
            if at is not None and row.at <= at:
                continue
            if label is not None and row.label != label:
                out.append((key[0], row.at, label, row.label))
            label, at = row.label, row.at
        if label is not None:
            self.last.update((label, at))
        yield pd.DataFrame(out, columns=["symbol", "at", "prev_label", "label"])

    def close(self) -> None:
        pass


def stream_alerts(bars: DataFrame, label: Column, symbol: str = "symbol") -> DataFrame:
    """Label changes per symbol over streamed bars; state is one row per symbol."""
    labelled = bars.select(F.col(symbol).alias("symbol"), F.unix_micros(F.col("w.start")).alias("at"),
                           label.alias("label"))
    return labelled.groupBy("symbol").transformWithStateInPandas(
        _LabelChange(), "symbol string, at long, prev_label string, label string", "Append", "None")


class _OrderedLabelChange(StatefulProcessor):
    """Holds rows back until the watermark passes them, then compares labels in order of event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "label string, at long")
        self.waiting = handle.getListState("waiting", "at long, label string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))[["at", "label"]]
        known = timerValues.getCurrentWatermarkInMs() * 1000
        late = batch[batch["at"] <= known]
        batch = batch[batch["at"] > known]
        if len(batch):
            self.waiting.appendList(list(batch.itertuples(index=False, name=None)))
            self.handle.registerTimer(_milliseconds(batch["at"].min()))
        yield _alerts(key[0], late.assign(prev_label=None, late=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = timerValues.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame(list(self.waiting.get()), columns=["at", "label"])
        due, rest = held[held["at"] <= known], held[held["at"] > known]
        if not len(due):  # an earlier timer of this batch has taken them
            return
        label, at = self.last.get() if self.last.exists() else (None, None)
        due = due.groupby("at", as_index=False)["label"].max()  # in order of time
        labels = pd.concat([pd.Series([label], dtype=object), due["label"]], ignore_index=True)
        due = due.assign(prev_label=labels.shift().iloc[1:].to_numpy(), late=False)
        self.last.update((due["label"].iloc[-1], int(due["at"].iloc[-1])))
        if len(rest):
            self.waiting.put(list(rest.itertuples(index=False, name=None)))
            self.handle.registerTimer(_milliseconds(rest["at"].min()))
        else:
            self.waiting.clear()
        yield _alerts(key[0], due[due["prev_label"].notna() & (due["prev_label"] != due["label"])])

    def close(self) -> None:
        pass


def _milliseconds(at: int) -> int:
    """First whole millisecond at or after a time in microseconds."""
    return -(-int(at) // 1000)


def _alerts(symbol: str, rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(symbol=symbol)[["symbol", "at", "prev_label", "label", "late"]]


def stream_ordered_alerts(rows: DataFrame, label: Column, symbol: str = "symbol", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Label changes per symbol in order of event time, for rows that arrive in any order.

    A row waits until the watermark (newest time seen less `delay`) has passed it, so the alerts do not depend on how the
    input is cut into batches; state is the last label and the rows of the last `delay`. Of rows with one time the greatest
    label counts; rows without label, symbol or time take no part. A row that comes behind the watermark changes nothing:
    Spark's operator drops and counts it (numRowsDroppedByWatermark) or, between two watermarks, it comes out marked `late`.
    """
    timed = with_event_time(rows.withColumn("_label", label), ts, delay).na.drop(subset=["_label", symbol, ts])
    labelled = timed.select(F.col(symbol).cast("string").alias("symbol"), F.col(ts), F.unix_micros(ts).alias("at"), F.col("_label").alias("label"))
    return labelled.groupBy("symbol").transformWithStateInPandas(
        _OrderedLabelChange(), "symbol string, at long, prev_label string, label string, late boolean", "Append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State provider that `stream_alerts` and `stream_ordered_alerts` need; call before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_upsert(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column], checkpoint: str,
                  partition: str) -> StreamingQuery:
    """Upsert every micro-batch into a partitioned dataset; a replayed batch changes nothing.

    Of the rows with a key the first in `order` stays, however the input is split into batches. `partition` must be one
    of the keys, so a batch rewrites only the partitions it touches.
    """
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = first_per_key(batch, keys, order)
        if sinks.has_partitions(spark, path, partition):
            sinks.upsert_path(spark, path, rows, keys, partition, order)
        else:  # first batch
            sinks.write_run_date(rows, path, partition)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_distinct(stream: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of each key that arrives; a key is forgotten once the watermark has passed, so state is bounded."""
    return with_event_time(stream, ts, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all available input and write it to files; nothing passes through the driver."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
