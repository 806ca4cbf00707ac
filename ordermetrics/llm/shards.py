"""Byte-balanced shards by histogram sort.

Rows are ordered by a 64-bit key: 40 bits from the text, so that equal texts stand
together, then 24 bits from doc_id, so that a group of copies can be cut anywhere.
Splitters start as guesses; each round counts the exact bytes below all probes in one
pass over the stored keys and narrows the brackets, until every splitter meets its
tolerance. The rows themselves are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermetrics.llm.common import utf8
from ordermetrics.session import written

LEAST, MOST = -(1 << 63), (1 << 63) - 1
PROBES = 64  # for each open splitter and round


def size_of(text: str = "text") -> Column:
    return F.octet_length(utf8(text)).cast("long") + 1


def sort_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    low = (1 << 24) - 1
    return F.xxhash64(F.col(text)).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.col(doc_id)).bitwiseAND(F.lit(low)))


def _below(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows with a key below each probe, exact."""
    edges = np.array(probes, dtype=np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch["key"].to_numpy(), "right")
            np.add.at(size, at, batch["size"].to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        used = np.flatnonzero(rows)
        yield pd.DataFrame({"at": used, "size": size[used], "rows": rows[used]})

    found = keys.mapInPandas(count, "at long, size long, rows long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).toPandas()
    size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    size[found["at"]], rows[found["at"]] = found["size"], found["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, total: int, shards: int, pieces: int, tolerance: float) -> list[int]:
    """``shards * pieces - 1`` ascending keys; rows with a key below one lie before it.

    Shard splitters are within ``tolerance`` of a shard's bytes, the others within a
    tenth of a piece, or as near as rows of one key allow.
    """
    n = shards * pieces
    goals = [total * j // n for j in range(1, n)]
    near = [tolerance * total / shards if j % pieces == 0 else 0.1 * total / n for j in range(1, n)]
    low, high = [LEAST] * (n - 1), [MOST] * (n - 1)
    low_bytes, high_bytes = [0] * (n - 1), [total] * (n - 1)
    found: dict[int, int] = {}
    while len(found) < n - 1:
        open_ = [j for j in range(n - 1) if j not in found]
        probes = sorted({low[j] + max(1, (high[j] - low[j]) * k // (PROBES + 1)) for j in open_ for k in range(1, PROBES + 1) if high[j] - low[j] > 1})
        below, _ = _below(keys, probes) if probes else (np.zeros(0, np.int64), None)
        places = np.array(probes, dtype=np.int64)
        for j in open_:
            at = int(np.searchsorted(below, goals[j], "right"))  # probes before it have at most the goal below them
            for i in (at - 1, at):
                if 0 <= i < len(places) and low[j] < places[i] < high[j]:
                    if below[i] <= goals[j]:
                        low[j], low_bytes[j] = int(places[i]), int(below[i])
                    else:
                        high[j], high_bytes[j] = int(places[i]), int(below[i])
            lower, upper = goals[j] - low_bytes[j], high_bytes[j] - goals[j]
            if min(lower, upper) <= near[j] or high[j] - low[j] <= 1:
                found[j] = low[j] if lower <= upper else high[j]
    return list(np.maximum.accumulate(np.array([found[j] for j in range(n - 1)], dtype=np.int64))) if n > 1 else []


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, piece_bytes: int = 16 << 20, most_pieces: int = 1024) -> DataFrame:
    """``docs`` with shard and slot: shards of near equal bytes (UTF-8 text plus 1 a row).

    Equal texts lie in one shard unless a cut falls inside their group. Slots count from 0
    in each shard, in key order. A shard is sorted in pieces of about ``piece_bytes``
    (``most_pieces`` a shard bounds the driver's arrays; no row is lost to it), so no
    task holds a shard. Null texts count one byte; rows equal in text and doc_id can't be
    parted. Without rows the result is empty. Columns shard and slot are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    keys = written(docs.select(sort_key().alias("key"), size_of().alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    pieces = max(1, min(most_pieces, -(-total // (shards * piece_bytes))))
    cuts = splitters(keys, total, shards, pieces, tolerance)
    n = shards * pieces
    edges = np.array(cuts, dtype=np.int64)
    below = _below(keys, cuts)[1] if cuts else np.zeros(0, np.int64)
    starts = np.concatenate([[0], below])
    base = starts - starts[(np.arange(n) // pieces) * pieces]
    offsets = spark.createDataFrame([(i, i // pieces, int(base[i])) for i in range(n)], "_piece int, shard int, _base long")

    @F.pandas_udf("int")
    def piece(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), "right").astype(np.int32))

    order = Window.partitionBy("_piece").orderBy("_key", "doc_id", F.xxhash64("text"))
    placed = docs.withColumn("_key", sort_key()).withColumn("_piece", piece("_key")).withColumn("_rank", F.row_number().over(order))
    # at most shards * most_pieces rows of 16 bytes
    return placed.join(F.broadcast(offsets), "_piece").withColumn("slot", F.col("_base") + F.col("_rank") - 1).drop("_piece", "_key", "_rank", "_base")
