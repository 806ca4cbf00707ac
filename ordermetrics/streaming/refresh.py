"""Incremental ingest, hourly and rolling counts, daily upsert, de-duplication.

State is bounded by watermarks; progress lives in a checkpoint folder, so a
lost executor or driver continues where the last batch ended.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ordermetrics.functions.timeframe import as_instant, wall_clock
from ordermetrics.sources.partitions import changed


class LateRows(RuntimeError):
    """Rows came after the watermark had passed them."""


def source(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*") -> DataFrame:
    """Files of a growing folder as a stream.

    What a run finds is one batch: with several, a backlog's older rows would be late
    for the watermark that the batches before them have set.
    """
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def finished(query: StreamingQuery, late: str = "raise") -> None:
    """Waits for a run. Rows that its watermark dropped raise; ``late="drop"`` accepts them."""
    query.awaitTermination()
    kept = int(SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates"))
    if late == "raise" and len(query.recentProgress) >= kept:
        raise LateRows(f"the run had more batches than the {kept} whose progress is kept; raise spark.sql.streaming.numRecentProgressUpdates")
    dropped = sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)
    if dropped and late == "raise":
        raise LateRows(f"{dropped} rows were later than the watermark allows; widen lateness or rebuild")


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived since the last run, then stop."""
    return (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def event_time(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Watermarked event time. Wall-clock times become instants of a UTC clock,
    so windows align with whole hours and days whatever the session zone."""
    wall = isinstance(stream.schema[ts].dataType, T.TimestampNTZType)
    return stream.withColumn(ts, as_instant(ts) if wall else F.col(ts)).withWatermark(ts, lateness)


def deduplicated(stream: DataFrame, ts: str, key: Sequence[str], lateness: str) -> DataFrame:
    """Each key once, as long as its repeats are no later than ``lateness``."""
    return event_time(stream, ts, lateness).dropDuplicatesWithinWatermark(list(key))


def _windowed(stream: DataFrame, window, groups: Sequence[str], measures) -> DataFrame:
    counted = stream.groupBy(window.alias("w"), *groups).agg(*measures)
    return counted.select(
        wall_clock("w.start").alias("window_start"), wall_clock("w.end").alias("window_end"),
        *[c for c in counted.columns if c != "w"],
    )


def hourly_counts(stream: DataFrame, ts: str, groups: Sequence[str], entity: str, lateness: str = "1 hour",
                  event_id: str | None = None) -> DataFrame:
    """Events and distinct entities per hour and attributes, both exact.

    With ``event_id`` repeated events count once. Two stateful steps follow each other:
    events per (hour, attributes, entity), then events and entities per (hour,
    attributes), so no state holds more than a number for each entity.
    """
    timed = event_time(stream, ts, lateness)
    if event_id is not None:
        timed = timed.dropDuplicatesWithinWatermark([event_id])
    each = timed.groupBy(F.window(ts, "1 hour").alias("hour"), *groups, entity).agg(F.count(F.lit(1)).alias("events"))
    measures = [F.sum("events").alias("events"), F.count(entity).alias("entities")]
    return _windowed(each, F.window("hour", "1 hour"), groups, measures)


def rolling_counts(stream: DataFrame, ts: str, groups: Sequence[str], lateness: str = "1 hour",
                   length: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Events of the last 24 hours, renewed every hour.

    Events are counted per ``step`` first; only those counts enter the sliding windows.
    """
    timed = event_time(stream, ts, lateness)
    steps = timed.groupBy(F.window(ts, step).alias("hour"), *groups).agg(F.count(F.lit(1)).alias("events"))
    return _windowed(steps, F.window("hour", length, step), groups, [F.sum("events").alias("events")])


def run_available(result: DataFrame, target: str, checkpoint: str, mode: str = "append", late: str = "raise") -> None:
    """Process what is there into a parquet folder and stop; see :func:`finished` for ``late``."""
    finished(
        result.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start(), late)


def merge_batch(batch: DataFrame, target: str, groups: Sequence[str], run: str, number: int) -> DataFrame:
    """Merges one batch of daily counts (date, groups, events) into ``target``, a folder a day, and returns the table.

    Only the batch's days are read and rewritten; of a changed day the groups the batch lacks stay. Each row carries the stream
    and the batch it comes from: a batch that is repeated, or comes after a later one of its stream, replaces only rows
    older than itself.
    """
    stamped = batch.select(
        F.date_format("date", "yyyy-MM-dd").alias("day"), "date", *groups, F.col("events").cast("long").alias("events"),
        F.lit(run).alias("run"), F.lit(number).cast("long").alias("batch"))

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        later = (F.col("run") == run) & (F.col("batch") > number)
        ranked = old.withColumn("__rank", F.when(later, 2).otherwise(0)).unionByName(new.withColumn("__rank", F.lit(1)))
        kept = ranked.groupBy("day", "date", *groups).agg(F.max_by(F.struct("events", "run", "batch"), "__rank").alias("__kept"))
        return kept.select("day", "date", *groups, "__kept.events", "__kept.run", "__kept.batch")

    return changed(stamped, target, "day", merge)


def upsert_daily(stream: DataFrame, ts: str, groups: Sequence[str], target: str, checkpoint: str,
                 lateness: str = "1 day") -> StreamingQuery:
    """Keep one count per day and group in ``target``, replacing a day when it changes.

    The table is one folder a day however many batches have run, see :func:`merge_batch`. A stream that starts
    anew on another checkpoint keeps the days it doesn't touch.
    """
    timed = event_time(stream, ts, lateness)
    daily = timed.groupBy(F.window(ts, "1 day").alias("w"), *groups).agg(F.count(F.lit(1)).alias("events"))
    rows = daily.select(wall_clock("w.start").alias("date"), *groups, "events")

    def store(batch: DataFrame, number: int) -> None:
        run = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]
        counts = batch.persist()  # read for its days and for its rows
        try:
            merge_batch(counts, target, groups, run, number)
        finally:
            counts.unpersist()

    return (
        rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )


def daily_state(spark: SparkSession, target: str, groups: Sequence[str]) -> DataFrame:
    """The current row per day and group of :func:`upsert_daily`."""
    return spark.read.parquet(target).select("date", *groups, "events")
