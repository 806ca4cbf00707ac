"""Reading tables, connected components and small expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordermetrics.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def utf8(text: str | Column) -> Column:
    """Bytes of a text, none for null."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def ascii_lower(text: str) -> Column:
    """Lower case for A-Z alone. A text of ASCII bytes only takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def freed() -> None:
    """Gives back what Arrow keeps of the memory it no longer uses; a Python worker would hold it beside later tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def text_key(text: str = "text") -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.col(text))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no classifier may learn from: crc32 of doc_id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, kind: str, n: int) -> DataFrame:
    """(doc_id, kind): of each ``kind`` the ``n`` rows whose doc_id hashes lowest.

    The size of a kind tells below which hash about that many rows lie, so hardly more
    than those are ranked, whatever the size of the table.
    """
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = rows.select("doc_id", kind)
    sizes = rows.groupBy(kind).agg(F.count("*").alias("_size"))
    # one row a kind (languages, classes), so only rows that can be in the sample are dealt by kind
    low = rows.join(F.broadcast(sizes), kind).withColumn("_share", share).where(F.col("_share") * F.col("_size") <= 1.25 * n + 100)
    order = Window.partitionBy(kind).orderBy("_share", "doc_id")
    return low.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).select("doc_id", kind)


def components(edges: DataFrame, purpose: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): (node, root), root the least node.

    Large-star and small-star steps alternate until the edges stop changing. Each step
    is written to the shared folder, so that a lost executor costs one step; only a
    count and a checksum reach the driver. A hub's edges are reduced by partial minima,
    and the joins are plain equi-joins that adaptive execution can split.
    """
    a, b = F.col("a"), F.col("b")
    now = written(
        edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), purpose)
    before = None
    for _ in range(most_rounds):
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.join(least, "a").where((b > a) & (b != F.col("m"))).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(a.alias("a"), F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.a", "e.b").where(a != b).distinct(), purpose)
    else:
        raise RuntimeError(f"no stable components after {most_rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
