"""Scans: CSV with an agreed schema, JDBC queries, JSON records, parameterised SQL."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermetrics.schemas import check_schema


# Quotes inside quotes are doubled, blanks belong to the value.
CSV_FORM = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, name: str = "dataset", line_breaks: bool = True) -> DataFrame:
    """CSV with header, matched to the schema by column name.

    Only the header is looked at to build the plan. A file of the folder whose header
    differs, a row of another length and a value that isn't of its column's type raise.
    Times may carry a zone suffix, which is cut off (wall-clock time is kept). Where no
    value holds a line break, ``line_breaks=False`` lets Spark read a large file in parts.
    """
    reader = spark.read.options(**CSV_FORM, multiLine=line_breaks)
    columns = reader.option("inferSchema", False).csv(path).columns
    raw = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    text = reader.schema(raw).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    missing = [f.name for f in schema.fields if f.name not in columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")

    def typed(f: T.StructField):
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampNTZType):
            column = F.regexp_replace(column, r"\s*(Z|[+-]\d{2}(:?\d{2})?)$", "")
            # a bare date's own "-dd" is not a zone
            column = F.when(F.col(f"`{f.name}`").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(f"`{f.name}`")).otherwise(column)
        cast = column.try_cast(f.dataType)
        wrong = F.raise_error(F.concat(F.lit(f"{name}.{f.name} isn't {f.dataType.simpleString()}: "), column)).cast(f.dataType)
        return F.when(column.isNotNull() & cast.isNull(), wrong).otherwise(cast).alias(f.name)

    return check_schema(text.select(*[typed(f) for f in schema.fields]), schema, name)


@dataclass(frozen=True)
class Database:
    """Where a JDBC source lives. Credentials are passed in by the deployment."""

    host: str
    database: str
    user: str
    password: str = field(repr=False)
    port: int | None = None
    kind: str = "postgresql"  # or "mysql"

    @property
    def url(self) -> str:
        port = self.port or {"postgresql": 5432, "mysql": 3306}[self.kind]
        return f"jdbc:{self.kind}://{self.host}:{port}/{self.database}"


def jdbc_options(source: Database, query: str, split_by: str | None = None, lower=None, upper=None,
                 parts: int = 1, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options; with ``split_by`` the query is read in ``parts`` ranges between its bounds in parallel.

    Without it the whole result passes through one task.
    """
    options = {"url": source.url, "user": source.user, "password": source.password, "fetchsize": str(fetch_size)}
    if split_by is None:
        return {**options, "query": query}
    if lower is None or upper is None:
        raise ValueError("a split needs both bounds")
    return {
        **options,
        "dbtable": f"({query}) AS q",
        "partitionColumn": split_by,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(parts),
    }


def read_jdbc(spark: SparkSession, source: Database, query: str, **split) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(source, query, **split)).load()


def run_query(spark: SparkSession, text: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """SQL with named parameters (``:name``); lists bind as arrays.

    Use ``array_contains(:names, column)`` where an IN list is meant. Values
    are bound, never pasted into the text.
    """
    bound = {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else v for k, v in (args or {}).items()}
    return spark.sql(text, args=bound) if bound else spark.sql(text)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, one_array: bool = False) -> DataFrame:
    """A published query result delivered as JSON records, a line each or, with ``one_array``, as one array.

    An array may be spread over lines; its file is read by one task. Text that isn't
    a record raises.
    """
    return spark.read.schema(schema).option("multiLine", one_array).option("mode", "FAILFAST").json(path)
