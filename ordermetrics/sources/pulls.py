"""Spec-driven pulls of query results into tables with a commit log.

A pull writes its rows to a new folder below ``rows`` and then one small entry to ``_pulls``: its number, that folder and
its mark, the greatest value of the update column so far. The entry is renamed into place whole and never over another,
so a pull is there or not; what a pull that died left behind is in no entry and is not read. The next pull takes the mark from
the newest entry, so nothing of the target is scanned for it. Nothing is moved or overwritten, which suits object stores too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.functions.predicates import where_optional
from ordermetrics.sources.readers import run_query


@dataclass(frozen=True)
class PullSpec:
    """What to pull and where to. ``update_column`` makes later pulls incremental;
    ``key`` identifies a row, so rows tied with the last value are taken once."""

    output: str
    query: str
    update_column: str | None = None
    key: Sequence[str] = ()
    args: Mapping[str, object] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> "PullSpec":
        """Spec text; line breaks inside strings are allowed."""
        raw = json.loads(text, strict=False)
        return cls(raw["output_file"], raw["query"], raw.get("update_query_param_source"),
                   tuple(raw.get("key", ())), raw.get("args", {}))


@dataclass(frozen=True)
class Commit:
    """One entry of the log. ``replaces`` says that earlier rows count no more."""

    number: int
    folder: str
    mark: str | None
    replaces: bool


def _store(spark: SparkSession, output: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(output).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commits(spark: SparkSession, output: str) -> list[Commit]:
    """The entries whose rows count, oldest first: the last that replaces and what follows it."""
    path, store = _store(spark, output)
    log = path(f"{output}/_pulls")
    if not store.exists(log):
        return []
    names = sorted(n for n in (f.getPath().getName() for f in store.listStatus(log)) if n.endswith(".json") and n[0].isdigit())
    found: list[Commit] = []
    for name in reversed(names):
        stream = store.open(path(f"{output}/_pulls/{name}"))
        try:
            entry = Commit(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()
        found.insert(0, entry)
        if entry.replaces:
            break
    return found


def _commit(spark: SparkSession, output: str, entry: Commit) -> None:
    """Puts the entry in place; one of the same number, by a pull at the same time, raises."""
    path, store = _store(spark, output)
    fresh = path(f"{output}/_pulls/.{uuid.uuid4().hex}")
    stream = store.create(fresh, False)
    try:
        stream.write(bytearray(json.dumps(entry.__dict__).encode()))
    finally:
        stream.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    context.rename(fresh, path(f"{output}/_pulls/{entry.number:010d}.json"), none)


def target_exists(spark: SparkSession, output: str) -> bool:
    return bool(commits(spark, output))


def pulled(spark: SparkSession, output: str) -> DataFrame:
    """The rows of all committed pulls."""
    entries = commits(spark, output)
    if not entries:
        raise FileNotFoundError(f"nothing was pulled into {output}")
    return spark.read.parquet(*[f"{output}/{e.folder}" for e in entries])


def _greatest(rows: DataFrame, column: str | None) -> str | None:
    # as text, so that no clock of this process or session shifts it
    return None if column is None else rows.agg(F.max(column).cast("string")).first()[0]


def _append(spark: SparkSession, spec: PullSpec, rows: DataFrame, before: Commit | None, replaces: bool) -> DataFrame:
    number = 1 if before is None else before.number + 1
    folder = f"rows/{number:010d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{spec.output}/{folder}")
    # the mark comes from the new rows alone
    mark = _greatest(spark.read.schema(rows.schema).parquet(f"{spec.output}/{folder}"), spec.update_column)
    if mark is None and before is not None and not replaces:
        mark = before.mark
    _commit(spark, spec.output, Commit(number, folder, mark, replaces))
    return pulled(spark, spec.output)


def full_pull(spark: SparkSession, spec: PullSpec, source: DataFrame | None = None) -> DataFrame:
    """Replace the target by the query's result; a failing pull leaves the last good one."""
    rows = run_query(spark, spec.query, spec.args) if source is None else source
    entries = commits(spark, spec.output)
    return _append(spark, spec, rows, entries[-1] if entries else None, True)


def new_rows(source: DataFrame, mark: str | None, column: str, key: Sequence[str] = (), tied: DataFrame | None = None, extra=None) -> DataFrame:
    """Source rows beyond the mark.

    With a ``key``, rows equal to the mark are read again and those already in ``tied``
    left out; without one only greater values are taken. The bound is one value and becomes a literal, so the
    source scan can skip files.
    """
    rows = where_optional(source, extra)
    if mark is None:
        return rows
    bound = F.lit(mark).cast(source.schema[column].dataType)
    if not key or tied is None:
        return rows.where(F.col(column) > bound)
    present = tied.where(F.col(column) == bound).select(*key).distinct()
    return rows.where(F.col(column) >= bound).join(present, list(key), "left_anti")


def pull(spark: SparkSession, spec: PullSpec, source: DataFrame | None = None) -> DataFrame:
    """Incremental when the target exists and the spec allows it, else full."""
    entries = commits(spark, spec.output)
    if spec.update_column is None or not entries:
        return full_pull(spark, spec, source)
    rows = run_query(spark, spec.query, spec.args) if source is None else source
    last = entries[-1]
    tied = None
    if spec.key and last.mark is not None:
        # only pulls with this mark can hold rows equal to it
        tied = spark.read.parquet(*[f"{spec.output}/{e.folder}" for e in entries if e.mark == last.mark])
    columns = spark.read.parquet(f"{spec.output}/{entries[0].folder}").columns
    return _append(spark, spec, new_rows(rows, last.mark, spec.update_column, spec.key, tied).select(*columns), last, False)


def compacted(spark: SparkSession, spec: PullSpec) -> DataFrame:
    """All committed rows in one folder under one entry; the mark stays. Readers of the old entries are not disturbed."""
    last = commits(spark, spec.output)[-1]
    folder = f"rows/{last.number + 1:010d}-{uuid.uuid4().hex}"
    pulled(spark, spec.output).write.parquet(f"{spec.output}/{folder}")
    _commit(spark, spec.output, Commit(last.number + 1, folder, last.mark, True))
    return pulled(spark, spec.output)


def dropped_leftovers(spark: SparkSession, output: str) -> list[str]:
    """Deletes row folders that no counting entry names, when no pull and no older reader runs; returns their names."""
    path, store = _store(spark, output)
    named = {e.folder.split("/")[1] for e in commits(spark, output)}
    found = [f.getPath().getName() for f in store.listStatus(path(f"{output}/rows"))]
    gone = sorted(n for n in found if n not in named)
    for name in gone:
        store.delete(path(f"{output}/rows/{name}"), True)
    return gone
