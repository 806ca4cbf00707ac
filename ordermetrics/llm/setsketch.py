"""MinHash near-de-duplication with SetSketch registers.

A register keeps the least of one exponential variable a shingle, on an exponential
scale of base ``BASE`` cut off at ``TOP``; registers of a union are the maxima. Bands of
registers bring candidates together, the joint likelihood of two sketches and the bits in
which hashed marks of the sets differ drop those that can't be alike, and full shingle
sets decide.

A hot band is never paired with itself: each member meets the band's least member and
the least of its sub-band. Only members that are then in different components meet in
blocks, so the links that are skipped lie inside one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermetrics.llm.common import components, freed, text_key
from ordermetrics.session import written

REGISTERS = 168
MISSED = 1e-5  # most chance with which a pair at the threshold meets in no band
BASE, RATE, TOP = 1.05, 20.0, 1022
DOUBT = 12.0  # log-likelihood by which a pair must miss the threshold to go unverified
MARKS = 2048  # bits of a set's mark; marks differ in no more bits than the sets in elements
BLOCK = 512

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word shingles, ascending; A-Z are lower-cased and ASCII white space parts words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        total = _mix(total * _M1 + hashed[i : len(words) - span + 1 + i] * _M3)
    return np.unique(total)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7)
    return draw.integers(0, 1 << 32, REGISTERS, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, REGISTERS, np.uint32)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set that isn't empty."""
    odd, plus = _multipliers()
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 4096):
        least = np.minimum(least, (odd[:, None] * x[None, at : at + 4096] + plus[:, None]).min(1))
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def marks(hashes: np.ndarray) -> bytes:
    """A bit for each element; equal elements have equal bits."""
    bits = np.zeros(MARKS, np.uint8)
    bits[(hashes & np.uint64(MARKS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def near_enough(marks_a: np.ndarray, marks_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Pairs whose marks (rows of 64-bit words) and sizes allow the similarity.

    The sets differ in as many elements as the marks differ in bits, or more, and may
    differ in (n_a + n_b) (1 - j) / (1 + j); so this drops no pair that is alike.
    """
    differ = np.bitwise_count(marks_a ^ marks_b).sum(1, dtype=np.int64)
    return differ * (denominator + numerator) <= (n_a + n_b) * (denominator - numerator)


def _rows(parts, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)


def band_shape(numerator: int, denominator: int) -> tuple[int, int]:
    """(bands, registers a band): the longest bands that miss hardly any pair at the threshold."""
    like = numerator / denominator
    rows = max([r for r in range(1, 13) if (1 - like**r) ** (REGISTERS // r) <= MISSED], default=1)
    return REGISTERS // rows, rows


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sketches, bands) hashes of the bands of (sketches, REGISTERS)."""
    parts = sketches[:, : bands * rows].reshape(len(sketches), bands, rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        total = _mix(total * _M1 + parts[:, :, i] + np.uint64(1))
    return total.view(np.int64)


def may_be_alike(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Pairs that sizes and joint likelihood leave open.

    ``greater`` and ``less`` count the registers in which a stands above and below b. The
    likelihood of a Jaccard value given them and the set sizes is that of the joint
    estimator; a pair stays unless the best value beats every one from the threshold up.
    """
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    share_a, share_b = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    equal = REGISTERS - greater - less
    least = numerator / denominator

    def step(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = step(share_a - share_b * j), step(share_b - share_a * j)
        return greater * np.log(up) + less * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-9, 1))

    best, best_above = np.full(most.shape, -np.inf), np.full(most.shape, -np.inf)
    for j in np.linspace(0, 1, 51):
        best = np.maximum(best, likelihood(np.minimum(j, most)))
        best_above = np.maximum(best_above, likelihood(np.minimum(least + (1 - least) * j, most)))
    return (denominator * np.minimum(n_a, n_b) >= numerator * np.maximum(n_a, n_b) * (1 - 1e-12)) & (best - best_above <= DOUBT)


def sketched(docs: DataFrame, width: int, shape: tuple[int, int]) -> DataFrame:
    """(doc_id, t, n_shingles, node, bands, sketch, marks) a row; node names the shingle set, null for an empty one."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, nodes, found, marked = [], [], [], []
            for text in batch["text"]:
                hashes = shingles(text, width)
                sizes.append(len(hashes))
                nodes.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                found.append(registers(hashes) if len(hashes) else np.zeros(REGISTERS, np.uint16))
                marked.append(marks(hashes))
            rows = np.array(found, dtype=np.uint16).reshape(-1, REGISTERS)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "t": batch["t"], "n_shingles": sizes, "node": nodes,
                "bands": list(band_keys(rows, *shape)), "sketch": [x.tobytes() for x in rows], "marks": marked})
            freed()

    docs = docs.select("doc_id", text_key().alias("t"), "text")
    return docs.mapInPandas(sketch, docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ") + ", t long, n_shingles long, node binary, bands array<bigint>, sketch binary, marks binary")


def _estimated(pairs: DataFrame, nodes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) that their sketches leave open."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"), F.col("marks").alias(f"m_{x}"))

    @F.pandas_udf("boolean")
    def open_(n_a: pd.Series, s_a: pd.Series, m_a: pd.Series, n_b: pd.Series, s_b: pd.Series, m_b: pd.Series) -> pd.Series:
        a, b, sizes = _rows(list(s_a), np.uint16), _rows(list(s_b), np.uint16), (n_a.to_numpy(), n_b.to_numpy())
        ok = near_enough(_rows(list(m_a), np.uint64), _rows(list(m_b), np.uint64), *sizes, numerator, denominator)
        return pd.Series(ok & may_be_alike((a > b).sum(1), (a < b).sum(1), *sizes, numerator, denominator))

    pairs = pairs.hint("merge").join(side("a"), "a").hint("merge")  # they grow with the documents, too
    return pairs.join(side("b"), "b").where(open_("n_a", "s_a", "m_a", "n_b", "s_b", "m_b")).select("a", "b")


def _texts(needed: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text): one text for each of the shingle sets ``needed`` (node)."""
    one = rows.join(needed, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("r")).select("node", F.col("r.doc_id").alias("_id"), F.col("r.t").alias("_t"))
    one = written(one, "pair-rows")
    source = docs.select("doc_id", "text").withColumn("t", text_key())
    # the asked texts grow with the documents, so this is a shuffle join at every size
    texts = source.join(one.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).select("node", "text").dropDuplicates(["node"])
    return written(texts, "pair-texts")


def _verified(pairs: DataFrame, texts: DataFrame, numerator: int, denominator: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, known = [], None, None
        for a, b in zip(left, right, strict=True):
            if b != last:
                last, known = b, shingles(b, width)
            mine = shingles(a, width)
            common = len(np.intersect1d(mine, known, assume_unique=True))
            out.append(denominator * common >= numerator * (len(mine) + len(known) - common))
        return pd.Series(out)

    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return written(both.where(alike("text_a", "text_b")).select("a", "b"), "links")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def links(docs: DataFrame, rows: DataFrame, numerator: int, denominator: int, width: int) -> DataFrame:
    """Links (a, b) between distinct shingle sets, enough of them for exact components."""
    bands, in_band = band_shape(numerator, denominator)
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("marks").alias("marks"))
    nodes = written(nodes, "sets")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    met = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("n > 1")
    met = written(met, "bands")
    # two members make a pair; more meet the least of the band and of the sub-band that the next band's key makes
    hot = met.where("n > 2").select("key", "low", "n")
    with_next = nodes.select("node", F.explode(F.transform("bands", lambda x, i: F.struct(
        x.alias("key"), i.alias("band"), F.get("bands", (i + 1) % bands).alias("next")))).alias("m")).select("node", "m.*")
    members = written(with_next.join(hot.hint("merge"), "key"), "hot-members")
    near = members.groupBy("key", "next").agg(F.min("node").alias("near"), F.count("*").alias("n2")).where("n2 > 1").select("key", "next", "near")
    near = members.join(near, ["key", "next"]).where((F.col("near") != F.col("low")) & (F.col("near") != F.col("node")))
    first = met.where("n = 2").select(*_ordered(F.col("low"), F.col("high"))).union(
        members.where(F.col("low") != F.col("node")).select(*_ordered(F.col("low"), F.col("node")))).union(
        near.select(*_ordered(F.col("near"), F.col("node")))).distinct()
    first = written(_estimated(first, nodes, numerator, denominator), "pairs")
    # texts of all that either check below can ask for, in one pass over the documents
    texts = _texts(first.select(F.col("a").alias("node")).union(first.select("b")).union(members.select("node")).distinct(), docs, rows)
    first = _verified(first, texts, numerator, denominator, width)

    # members of a hot band that aren't connected yet meet in blocks, those of its largest component on one side only
    known = components(first, "sets-so-far")
    members = members.join(known, "node", "left").select("node", "key", "band", "n", F.coalesce("root", "node").alias("root"))
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("of"))
    main = sizes.groupBy("key").agg(F.max(F.struct("of", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("m.root").alias("main"), F.col("m.of").alias("of"))
    open_ = members.join(main, "key").join(nodes.select("node", "n_shingles", "sketch", "marks"), "node")
    open_ = open_.withColumn("right_blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("left_blocks", F.ceil((F.col("n") - F.col("of")) / BLOCK).cast("int"))
    spread = F.pmod(F.hash("node"), F.lit(1 << 30))
    right = open_.select("*", F.lit(False).alias("left"), (spread % F.col("right_blocks")).alias("j"), F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"))
    left = open_.where(F.col("root") != F.col("main")).select("*", F.lit(True).alias("left"), F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)).alias("j"), (spread % F.col("left_blocks")).alias("i"))
    columns = ["key", "i", "j", "band", "left", "node", "root", "main", "n_shingles", "sketch", "marks"]
    blocks = left.select(*columns).union(right.select(*columns))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        band = int(block["band"].iloc[0])
        mine, other = block[block["left"]], block[~block["left"]]
        if not len(mine) or not len(other):
            return pd.DataFrame({"a": [], "b": []})
        regs, bits = _rows(list(other["sketch"]), np.uint16), _rows(list(other["marks"]), np.uint64)
        names, roots, sizes = (other[c].to_numpy() for c in ("node", "root", "n_shingles"))
        minor = roots != other["main"].to_numpy()
        out = []
        for node, root, size, sketch, mark in zip(mine["node"], mine["root"], mine["n_shingles"], mine["sketch"], mine["marks"], strict=True):
            one, its = np.frombuffer(sketch, np.uint16)[None, :], np.frombuffer(mark, np.uint64)[None, :]
            # each pair from one side if both are left, and below once: in the first band both share
            at = np.flatnonzero((roots != root) & (~minor | (names > node)) & near_enough(bits, its, sizes, size, numerator, denominator))
            same = (regs[at] == one)[:, : bands * in_band].reshape(-1, bands, in_band).all(2)
            at = at[same[:, band] & (same.argmax(1) == band)] if len(at) else at
            if len(at):
                ok = may_be_alike((one > regs[at]).sum(1), (one < regs[at]).sum(1), np.full(len(at), size), sizes[at], numerator, denominator)
                out += [(min(node, names[k]), max(node, names[k])) for k in at[ok]]
        return pd.DataFrame(out, columns=["a", "b"])

    rest = blocks.groupBy("key", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()
    return first.union(_verified(rest, texts, numerator, denominator, width))


def near_duplicates(docs: DataFrame, numerator: int = 80, denominator: int = 100, width: int = 5) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Documents are linked whose sets of shingles of ``width`` words (the whole sequence if
    it is shorter) have a Jaccard similarity of
    ``numerator / denominator`` or more. component_id is the least doc_id reachable, kept
    tells the document that has it; a repeated row of that doc_id is kept as well. Texts
    without words (null, empty, white space) are linked with nothing; so are equal ones
    among them. A null doc_id names no component unless all its documents have none.
    """
    rows = written(sketched(docs, width, band_shape(numerator, denominator)), "sketches")
    roots = components(links(docs, rows, numerator, denominator, width), "sets").withColumnRenamed("root", "c")
    with_root = rows.select("doc_id", "t", "n_shingles", "node").join(roots, "node", "left").withColumn("c", F.coalesce("c", "node"))
    with_root = written(with_root.select("doc_id", "t", "n_shingles", "c"), "roots")
    least = with_root.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    out = with_root.join(least, "c", "left").withColumn("component_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "t", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, numerator: int = 80, denominator: int = 100, width: int = 5) -> DataFrame:
    """One document of each group of near copies: ``docs`` without those that aren't kept; all columns stay."""
    gone = near_duplicates(docs, numerator, denominator, width).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (text_key() == gone["_t"]), "left_anti")
