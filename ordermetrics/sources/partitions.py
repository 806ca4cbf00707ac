"""Partitions of a table replaced as a whole, in a way that can be taken up again.

New contents are first written beside the table, below ``_staged``, where readers of the table don't look, and then
take the place of its partitions. A run that dies in between leaves either an incomplete staging, which counts for nothing, or a
complete one, which :func:`recovered` puts in place before anything is read for the next change. So no rows are lost,
even though a partition is gone for a moment while files change places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _store(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _swap(spark: SparkSession, table: str, staged: str, schema: T.StructType, by: str) -> None:
    path, store = _store(spark, table)
    rows = spark.read.schema(schema).parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(table)
    store.delete(path(staged), True)


def recovered(spark: SparkSession, table: str, schema: T.StructType, by: str) -> int:
    """Ends what an earlier run left half-done; returns how many complete stagings were put in place."""
    path, store = _store(spark, table)
    beside = path(f"{table}/_staged")
    done = 0
    for entry in sorted(store.listStatus(beside), key=lambda e: e.getModificationTime()) if store.exists(beside) else ():
        staged = entry.getPath().toString()
        if store.exists(path(f"{staged}/_SUCCESS")):
            _swap(spark, table, staged, schema, by)
            done += 1
        else:
            store.delete(path(staged), True)
    return done


def stored(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The table's rows, none where it has no partition yet."""
    path, store = _store(spark, table)
    if not store.exists(path(table)) or not any(e.isDirectory() and "=" in e.getPath().getName() for e in store.listStatus(path(table))):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(table)


def changed(rows: DataFrame, table: str, by: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Merges ``rows`` into the table at ``table``, whose text column ``by`` names its folders, and returns it.

    ``merge(old, new)`` gets the rows of the partitions that ``rows`` touch and gives their new contents, in the columns
    of ``rows``. Other partitions are neither read nor written. One change at a time may run on a table.
    """
    spark, schema = rows.sparkSession, rows.schema
    recovered(spark, table, schema, by)
    touched = [r[by] for r in rows.select(by).distinct().collect()]  # names of folders, those of one load
    old = stored(spark, table, schema).where(F.col(by).isin(touched))
    staged = f"{table}/_staged/{uuid.uuid4().hex}"
    # a folder's rows come from one task, so it has one file
    merge(old, rows).select(*rows.columns).repartition(by).write.partitionBy(by).parquet(staged)
    _swap(spark, table, staged, schema, by)
    return stored(spark, table, schema)
