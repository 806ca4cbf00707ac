"""Pulls, snapshots and streams over the test tables.

Each query writes to a new folder below the session's shared folder and
returns what a reader of the result finds there.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermetrics.catalog.views import Tables
from ordermetrics.functions.timeframe import day, wall_clock
from ordermetrics.session import scratch_folder
from ordermetrics.sources import layout, pulls, readers, snapshots
from ordermetrics.streaming import refresh

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)
TURN_SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
     T.StructField("text", T.StringType())]
)


def s01_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Orders exported as CSV and read back with their schema."""
    path = scratch_folder(spark, "csv")
    orders = Tables(spark, folder).raw("orders")
    snapshots.export_csv(orders, path)
    return readers.read_csv(spark, path, orders.schema, "orders")


def s01_csv_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes, commas and line breaks there and back."""
    path = scratch_folder(spark, "csv")
    quoted = Tables(spark, folder).raw("documents").withColumn("text", F.concat(F.lit('"Said", he:\n '), "text", F.lit(' ""end" ')))
    snapshots.export_csv(quoted, path, rows_per_file=200)
    return readers.read_csv(spark, path, quoted.schema, "documents")


def s03_named_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Stored query with a date range and a list of products as bound parameters."""
    Tables(spark, folder).claims().createOrReplaceTempView("claims_for_query")
    return readers.run_query(
        spark,
        """SELECT product, count(DISTINCT id) AS n FROM claims_for_query
           WHERE creation_date BETWEEN CAST(:start AS TIMESTAMP_NTZ) AND CAST(:end AS TIMESTAMP_NTZ)
           AND array_contains(:products, product) GROUP BY product""",
        {"start": "1997-01-01", "end": "1999-12-31", "products": ["1-URGENT", "5-LOW"]},
    )


def s05_full_pull(spark: SparkSession, folder: str) -> DataFrame:
    Tables(spark, folder).raw("orders").createOrReplaceTempView("orders_for_pull")
    spec = pulls.PullSpec(
        scratch_folder(spark, "pull"),
        "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders_for_pull WHERE o_orderdate > CAST(:since AS TIMESTAMP_NTZ)",
        args={"since": "1997-12-31"},
    )
    return pulls.pull(spark, spec)


def s06_incremental_pull(spark: SparkSession, folder: str) -> DataFrame:
    """A first pull in the middle of the table, then two more that add the rest once."""
    events = Tables(spark, folder).raw("events")
    spec = pulls.PullSpec(scratch_folder(spark, "pull"), "", update_column="ts", key=("event_id",))
    pulls.pull(spark, spec, events.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    pulls.pull(spark, spec, events)
    return pulls.pull(spark, spec, events)


def s07_json_import(spark: SparkSession, folder: str) -> DataFrame:
    """Records as JSON lines and as files of one array over many lines, about a thousand records each, stored as a table."""
    path, turns = scratch_folder(spark, "json"), Tables(spark, folder).raw("conversations")
    turns.where("conv_id % 2 = 0").write.json(f"{path}/lines")
    odd = turns.where("conv_id % 2 = 1")
    # the number of files grows with the records, so no file and no task does
    file = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(odd.count() // 1000 + 1))
    listed = odd.groupBy(file).agg(F.collect_list(F.struct("conv_id", "turn", "role", "text")).alias("turns"))
    pretty = listed.select(F.to_json("turns", {"pretty": "true"}).alias("value"))
    pretty.write.option("maxRecordsPerFile", 1).text(f"{path}/arrays")
    records = readers.read_json_records(spark, f"{path}/lines", TURN_SCHEMA).unionByName(
        readers.read_json_records(spark, f"{path}/arrays", TURN_SCHEMA, one_array=True))
    return pulls.full_pull(spark, pulls.PullSpec(scratch_folder(spark, "pull"), ""), records)


def s09_newest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Three snapshots, and a newer one of a table of like name; a failing fourth pull falls back to the newest of its own."""
    root, orders = scratch_folder(spark, "snapshots"), Tables(spark, folder).raw("orders")
    for stamp, status in (("20240101_000000", "P"), ("20240103_120000", "F"), ("20240102_235959", "O")):
        snapshots.write_snapshot(orders.where(F.col("o_orderstatus") == status), root, "orders", stamp)

    snapshots.write_snapshot(orders.where("false"), root, "orders_eu", "20240105_000000")

    def failing() -> DataFrame:
        raise ConnectionError("source is not reachable")

    return snapshots.refresh_or_last_good(spark, failing, root, "orders", "20240104_000000")


def s11_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Two archive runs; what the first one copied is there after the second, which finds it gone from the source."""
    root, orders = scratch_folder(spark, "snapshots"), Tables(spark, folder).raw("orders")
    for month in ("01", "02", "03"):
        source = f"{root}/kept" if month == "01" else f"{root}/later"
        snapshots.write_snapshot(orders.where(F.month("o_orderdate") == int(month)), source, "orders", f"2024{month}01_000000")
    snapshots.archive_before(spark, f"{root}/kept", "orders", "20240301_000000", f"{root}/archive")
    for _ in range(2):
        snapshots.archive_before(spark, f"{root}/later", "orders", "20240301_000000", f"{root}/archive")
    return spark.read.parquet(f"{root}/archive/orders").select("o_orderkey", F.col("pull_ts").cast("string").alias("pull_ts"))


def s14_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Three datasets in the order they were stored, the first one renewed by a last pull, each with its rows."""
    root, t = scratch_folder(spark, "fresh"), Tables(spark, folder)
    names = ["orders", "lineitem", "events"]
    for name in [*names, "orders"]:
        pulls.full_pull(spark, pulls.PullSpec(f"{root}/{name}", ""), t.raw(name))
        time.sleep(0.01)  # stores keep whole milliseconds
    paths = {name: f"{root}/{name}/{pulls.commits(spark, f'{root}/{name}')[-1].folder}" for name in names}
    ages = snapshots.freshness(spark, paths)
    place = F.row_number().over(Window.orderBy("last_pull")).alias("place")
    counts = reduce(lambda a, b: a.unionByName(b), [pulls.pulled(spark, f"{root}/{n}").agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit(n)) for n in names])
    return ages.select("dataset", place).join(counts, "dataset")


def s13_daily_upsert_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """The same with several rows a day, one per event type."""
    root, events = scratch_folder(spark, "daily"), Tables(spark, folder).raw("events")
    daily = events.groupBy(day("ts").alias("date"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    early = daily.where("date < TIMESTAMP_NTZ '2024-01-20 00:00:00'").withColumn("n", F.col("n") * 0)
    snapshots.upsert_days(spark, early, root, "blocked", "20240120_000000", ["date", "event_type"])
    late = daily.where("date >= TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    return snapshots.upsert_days(spark, late, root, "blocked", "20240131_000000", ["date", "event_type"])


def s13_daily_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Daily event counts stored in two loads; days loaded twice keep the second value."""
    root, events = scratch_folder(spark, "daily"), Tables(spark, folder).raw("events")
    daily = events.groupBy(day("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    early = daily.where("date < TIMESTAMP_NTZ '2024-01-20 00:00:00'").withColumn("n", F.col("n") * 0)
    snapshots.upsert_days(spark, early, root, "blocked", "20240120_000000")
    late = daily.where("date >= TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    return snapshots.upsert_days(spark, late, root, "blocked", "20240131_000000")


def l01_month_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Shipments stored by month; a range of days reads the folders of its months only."""
    path, lines = scratch_folder(spark, "months"), Tables(spark, folder).raw("lineitem")
    layout.write_by_month(lines, path, "l_shipdate", files_per_month=1 + lines.count() // 5_000_000)
    quarter = layout.read_by_month(spark, path, "l_shipdate", "1997-03-10", "1997-05-20")
    return quarter.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


def l02_bucketed_join(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and their lines stored in buckets of the order, joined and counted per order state without moving either."""
    t, run = Tables(spark, folder), uuid.uuid4().hex
    buckets = 8 * (1 + t.raw("lineitem").count() // 50_000_000)
    orders = layout.save_bucketed(t.raw("orders").select(F.col("o_orderkey").alias("order_id"), "o_orderstatus"), f"layout_orders_{run}", "order_id", buckets)
    lines = layout.save_bucketed(t.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), "l_quantity"), f"layout_lines_{run}", "order_id", buckets)
    per_order = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return orders.hint("merge").join(per_order, "order_id").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("n").alias("lines"), F.sum(F.col("q").cast("decimal(18,2)")).cast("double").alias("quantity"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    # a glob, so that the table may be one file or a folder of files
    return refresh.source(spark, f"{folder}/{{events}}.parquet", EVENT_SCHEMA)


def st01_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs of the ingest; the second finds nothing new."""
    target, progress = scratch_folder(spark, "ingest"), scratch_folder(spark, "progress")
    for _ in range(2):
        refresh.ingest(_events(spark, folder), target, progress).awaitTermination()
    return spark.read.parquet(target)


def st02_hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Closed hours per event type: events and distinct users."""
    target = scratch_folder(spark, "hourly")
    counts = refresh.hourly_counts(_events(spark, folder), "ts", ["event_type"], "user_id", "1 hour", "event_id")
    refresh.run_available(counts, target, scratch_folder(spark, "progress"))
    return spark.read.parquet(target)


def st02_hourly_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The same by several attributes."""
    target = scratch_folder(spark, "hourly")
    sized = _events(spark, folder).withColumn("large", F.col("value") > 50)
    counts = refresh.hourly_counts(sized, "ts", ["event_type", "large"], "user_id")
    refresh.run_available(counts, target, scratch_folder(spark, "progress"))
    return spark.read.parquet(target)


def st03_rolling_24h(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark, "rolling")
    counts = refresh.rolling_counts(_events(spark, folder), "ts", ["event_type"])
    refresh.run_available(counts, target, scratch_folder(spark, "progress"))
    return spark.read.parquet(target)


def st04_upsert(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark, "upsert")
    refresh.finished(refresh.upsert_daily(_events(spark, folder), "ts", ["event_type"], target, scratch_folder(spark, "progress")))
    return refresh.daily_state(spark, target, ["event_type"])


def st05_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The stream read twice over; every event is stored once."""
    target = scratch_folder(spark, "dedupe")
    doubled = _events(spark, folder).unionByName(_events(spark, folder))
    once = refresh.deduplicated(doubled, "ts", ["event_id"], "1 day").withColumn("ts", wall_clock("ts"))
    refresh.run_available(once, target, scratch_folder(spark, "progress"))
    return spark.read.parquet(target)


QUERIES = {
    f.__name__: f
    for f in (
        s01_csv_scan, s01_csv_text, s11_archive, s14_freshness, s13_daily_upsert_by_type, s03_named_parameters, s05_full_pull, s06_incremental_pull, s07_json_import, s09_newest_snapshot,
        s13_daily_upsert, l01_month_folders, l02_bucketed_join, st01_ingest, st02_hourly_counts, st02_hourly_entities, st03_rolling_24h, st04_upsert, st05_dedupe,
    )
}

_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"

ORACLE = {
    "s01_csv_scan": "SELECT * FROM orders",
    "s01_csv_text": """SELECT doc_id, '"Said", he:' || chr(10) || ' ' || text || ' ""end" ' AS text, lang, source, n_chars FROM documents""",
    "s11_archive": """SELECT o_orderkey, '20240' || CAST(month(o_orderdate) AS VARCHAR) || '01_000000' AS pull_ts FROM orders WHERE month(o_orderdate) < 3""",
    "s14_freshness": """SELECT 'lineitem' AS dataset, CAST(1 AS INTEGER) AS place, count(*) AS n FROM lineitem UNION ALL
        SELECT 'events', 2, count(*) FROM events UNION ALL SELECT 'orders', 3, count(*) FROM orders""",
    "s13_daily_upsert_by_type": """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS date, event_type,
        CASE WHEN date_trunc('day', ts) < TIMESTAMP '2024-01-10' THEN 0 ELSE count(*) END AS n FROM events GROUP BY date_trunc('day', ts), event_type""",
    "s03_named_parameters": """SELECT o_orderpriority AS product, count(DISTINCT o_orderkey) AS n FROM orders
        WHERE o_orderdate + to_hours(o_orderkey % 20) BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'
        AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1""",
    "s05_full_pull": "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderdate > TIMESTAMP '1997-12-31'",
    "s06_incremental_pull": "SELECT * FROM events",
    "s07_json_import": "SELECT conv_id, turn, role, text FROM conversations",
    "s09_newest_snapshot": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "s13_daily_upsert": """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS date,
        CASE WHEN date_trunc('day', ts) < TIMESTAMP '2024-01-10' THEN 0 ELSE count(*) END AS n FROM events GROUP BY date_trunc('day', ts)""",
    "l01_month_folders": """SELECT l_linestatus, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-03-10' AND l_shipdate < TIMESTAMP '1997-05-21' GROUP BY 1""",
    "l02_bucketed_join": """SELECT o_orderstatus, count(DISTINCT o_orderkey) AS orders, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "st01_ingest": "SELECT * FROM events",
    "st02_hourly_counts": f"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('hour', ts) + INTERVAL 1 HOUR AS TIMESTAMP) AS window_end,
        event_type, count(*) AS events, count(DISTINCT user_id) AS entities FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY ALL""",
    "st02_hourly_entities": f"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('hour', ts) + INTERVAL 1 HOUR AS TIMESTAMP) AS window_end,
        event_type, value > 50 AS large, count(*) AS events, count(DISTINCT user_id) AS entities FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY ALL""",
    "st03_rolling_24h": f"""WITH w AS (SELECT date_trunc('hour', ts) - to_hours(k) AS s, event_type FROM events, (SELECT unnest(generate_series(0, 23)) AS k))
        SELECT CAST(s AS TIMESTAMP) AS window_start, CAST(s + INTERVAL 24 HOURS AS TIMESTAMP) AS window_end, event_type, count(*) AS events
        FROM w WHERE s + INTERVAL 24 HOURS <= {_CLOSED} GROUP BY ALL""",
    "st04_upsert": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS date, event_type, count(*) AS events FROM events GROUP BY ALL",
    "st05_dedupe": "SELECT * FROM events",
}
