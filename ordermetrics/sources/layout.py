"""How tables are stored so that later scans and joins read and move less."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.functions.predicates import in_days, moment

MONTH = "event_month"


def write_by_month(df: DataFrame, path: str, ts: str, sort_by: Sequence[str] = (), mode: str = "overwrite",
                   files_per_month: int = 1) -> None:
    """Parquet with one folder per month of ``ts``.

    Rows of a month go to ``files_per_month`` tasks in no particular order, so
    a month holding a large part of the table does not end in one task; raise
    the number with the size of a month.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_month))
    placed = df.withColumn(MONTH, F.date_format(ts, "yyyy-MM")).repartition(F.col(MONTH), spread)
    ordered = placed.sortWithinPartitions(MONTH, *sort_by) if sort_by else placed
    ordered.write.mode(mode).partitionBy(MONTH).parquet(path)


def read_by_month(spark: SparkSession, path: str, ts: str, start, end) -> DataFrame:
    """Rows of whole days ``start..end``; only the months in between are listed and read."""
    month = F.col(MONTH).cast("string")
    months = (month >= F.date_format(moment(start), "yyyy-MM")) & (month <= F.date_format(moment(end), "yyyy-MM"))
    return spark.read.parquet(path).where(months & in_days(ts, start, end)).drop(MONTH)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort_by: Sequence[str] = ()) -> DataFrame:
    """A table bucketed by its join key.

    Tables bucketed alike join and aggregate on the key without a shuffle.
    Keys so frequent that a bucket outgrows a task belong in a plain table,
    where adaptive execution can split them.
    """
    order = list(sort_by) or [key]
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(*order).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)
