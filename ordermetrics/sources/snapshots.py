"""Timestamped snapshots: write, find the newest, fall back, archive, freshness."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.functions.scalars import snapshot_stamp
from ordermetrics.operators.rank import append_rows, last_loaded_per_key
from ordermetrics.sources.readers import CSV_FORM

STAMP = "%Y%m%d_%H%M%S"
log = logging.getLogger(__name__)


def stamp_of(moment: datetime) -> str:
    return moment.strftime(STAMP)


def write_snapshot(df: DataFrame, root: str, table: str, stamp: str) -> str:
    """Write ``<root>/<table>/pull_ts=<stamp>`` and return that path."""
    datetime.strptime(stamp, STAMP)
    path = f"{root}/{table}/pull_ts={stamp}"
    df.write.mode("overwrite").parquet(path)
    return path


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, modification time and length of the data files below a folder.

    Only the listing is used; file contents are never read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return listed.select("path", "modificationTime", "length")


def newest_stamp(spark: SparkSession, root: str, table: str) -> str | None:
    """The greatest ``YYYYmmdd_HHMMSS`` of a table's own snapshot folders."""
    return stored_stamps(spark, root, table).agg(F.max("stamp")).first()[0]


def stored_stamps(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(stamp): one row a snapshot of the table; empty if it has none."""
    try:
        found = files(spark, f"{root}/{table}/pull_ts=*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "stamp string")
    return found.select(F.regexp_extract("path", r"/pull_ts=(\d{8}_\d{6})/[^/]+$", 1).alias("stamp")).where("stamp <> ''").distinct()


def read_newest(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The newest snapshot of a table."""
    stamp = newest_stamp(spark, root, table)
    if stamp is None:
        raise FileNotFoundError(f"no snapshot of {table} under {root}")
    return spark.read.parquet(f"{root}/{table}/pull_ts={stamp}")


def read_newest_csv(spark: SparkSession, folder: str, table: str, reader: Callable[[str], DataFrame]) -> DataFrame:
    """The newest ``<table>_<stamp>.csv`` or ``<table>_db_pull_at_<stamp>.csv`` of a folder, read with ``reader(path)``."""
    own = rf"/{re.escape(table)}_(db_pull_at_)?\d{{8}}_\d{{6}}\.csv$"
    named = files(spark, folder, f"{table}_*.csv").where(F.col("path").rlike(own)).withColumn("stamp", snapshot_stamp("path"))
    newest = named.orderBy(F.col("stamp").desc(), "path").select("path").first()
    if newest is None:
        raise FileNotFoundError(f"no stamped file of {table} in {folder}")
    return reader(newest[0])


def refresh_or_last_good(spark: SparkSession, source: Callable[[], DataFrame], root: str, table: str, stamp: str) -> DataFrame:
    """Pull afresh into a snapshot; when that fails, read the last good one.

    The fresh rows are written before they are used, so a source that breaks
    half-way cannot leave a half result.
    """
    try:
        write_snapshot(source(), root, table, stamp)
    except Exception:
        log.exception("pull of %s failed, using the last snapshot", table)
    return read_newest(spark, root, table)


def archive_before(spark: SparkSession, root: str, table: str, stamp: str, archive: str) -> None:
    """Copy snapshots older than ``stamp`` to the archive, one partition each.

    Only the partitions that are copied are written, so what the archive holds of
    snapshots that retention has removed stays. Originals are left to the storage's own
    retention. Nothing is done if there is no older snapshot.
    """
    older = stored_stamps(spark, root, table).where(F.col("stamp") < stamp)
    if older.isEmpty():
        return
    old = spark.read.parquet(f"{root}/{table}").withColumn("pull_ts", F.col("pull_ts").cast("string")).where(F.col("pull_ts") < stamp)
    old.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pull_ts").parquet(f"{archive}/{table}")


def freshness(spark: SparkSession, datasets: dict[str, str]) -> DataFrame:
    """Last modification time per dataset."""
    parts = [
        files(spark, path).agg(F.max("modificationTime").alias("last_pull")).select(F.lit(name).alias("dataset"), "last_pull")
        for name, path in datasets.items()
    ]
    return append_rows(*parts)


def upsert_days(spark: SparkSession, today: DataFrame, root: str, table: str, stamp: str, key: Sequence[str] = ("date",)) -> DataFrame:
    """Append today's rows to the newest snapshot and keep the last loaded row per ``key``.

    A load that holds a key twice raises, as either row could be the right one. The
    result is a new snapshot, so the one being read is never overwritten.
    """
    twice = today.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").first()
    if twice is not None:
        raise ValueError(f"{table}: one load has several rows of {tuple(twice)[:-1]}")
    previous = newest_stamp(spark, root, table)
    loaded = today.withColumn("__load", F.lit(1))
    if previous is not None:
        kept = spark.read.parquet(f"{root}/{table}/pull_ts={previous}").withColumn("__load", F.lit(0))
        loaded = append_rows(kept, loaded)
    merged = last_loaded_per_key(loaded, list(key), "__load").drop("__load")
    return spark.read.parquet(write_snapshot(merged, root, table, stamp))


def export_csv(df: DataFrame, path: str, one_file: bool = False, rows_per_file: int = 1_000_000) -> None:
    """CSV with header, as :func:`~ordermetrics.sources.readers.read_csv` reads it. ``one_file`` is for metric tables, which are small."""
    rows = df.coalesce(1) if one_file else df
    rows.write.mode("overwrite").options(**CSV_FORM).option("maxRecordsPerFile", rows_per_file).csv(path)
