"""Near-duplicate vectors by product quantisation.

Coarse centroids make inverted lists; what is left of a vector after its centroid is
stored as one code a subspace. Lists near each other lie in one slab, and each two slabs
meet once. A query asks every list that can hold a link, whose members lie within the
list's radius of its centre. The distance from a coded member is a sum over subspaces:
that over the leading ones, as many as tell most pairs apart, comes for all members at
once from one matrix product with the decoded members, that over all subspaces for those
that remain. The exact cosine decides for those whose distance may reach the threshold: a
stored vector lies within its own coding error of its code. No step loses a link. Vectors
without clusters leave no list to pass over, so their work grows with the square of their
number, at one short product a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermetrics.llm.common import components
from ordermetrics.session import written

BLOCK = 1024  # members that meet queries in one product, about
QUERIES = 384  # queries of one product; its result stays in a core's cache
SLAB = 16_384  # vectors in a row of the stored slabs, about
SLABS = 24  # slabs of a small table, whose slabs are smaller
CODES = 256
SAMPLE = 16_384
TEST = 2048  # vectors beyond the sample that tell how well it codes others
KEYS = ["key0", "key1"]
FEW = 1 / 16384  # pairs that the leading subspaces may leave beyond those that all leave
SLACK = 1e-4  # more than what single precision can lose in a product of unit vectors


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimension
    books: np.ndarray  # subspaces x CODES x width
    lead: int  # subspaces asked first

    @property
    def dims(self) -> int:
        """Dimensions of the leading subspaces."""
        return min(self.lead * self.books.shape[2], self.centroids.shape[1])


def _kmeans(points: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[draw.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, points)
        n = np.bincount(nearest, minlength=len(centres))
        full = n > 0
        centres[full] = total[full] / n[full, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, in single precision."""
    out = np.empty(len(points), np.int32)
    norms, turned = (centres**2).sum(1).astype(np.float32), (-2 * centres.T).astype(np.float32)
    for at in range(0, len(points), BLOCK):
        far = points[at : at + BLOCK].astype(np.float32) @ turned
        far += norms
        out[at : at + BLOCK] = far.argmin(1)
    return out


def fit(sample: np.ndarray, lists: int, subspaces: int = 16) -> Index:
    """Learns centroids and code books from unit vectors."""
    draw = np.random.default_rng(5)
    centroids = _kmeans(sample, lists, draw)
    near = _nearest(sample, centroids)
    rest = sample - centroids[near]
    width = -(-sample.shape[1] // subspaces)
    subspaces = -(-sample.shape[1] // width)
    rest = np.pad(rest, ((0, 0), (0, subspaces * width - sample.shape[1]))).reshape(len(rest), subspaces, width)
    books = np.zeros((subspaces, CODES, width))
    for s in range(subspaces):
        found = _kmeans(np.ascontiguousarray(rest[:, s]), CODES, draw, 5)
        books[s, : len(found)] = found
        books[s, len(found) :] = found[0]
    return Index(centroids, books, subspaces)


def leading(index: Index, others: np.ndarray, link: float) -> int:
    """How many subspaces tell apart nearly all pairs of ``others`` that all subspaces tell apart."""
    near = _nearest(others, index.centroids)
    codes, error = encode(others, near, index)
    u, v = np.random.default_rng(6).integers(len(others), size=(2, 1 << 15))
    u, v = u[u != v], v[u != v]
    if not len(u):
        return index.lead
    far = (_parts(others[u] - decode(codes[v], near[v], index), index) ** 2).sum(2).cumsum(1)
    left = (far <= (link + np.sqrt(error[v].cumsum(1))) ** 2).mean(0)
    return int(np.argmax(left <= left[-1] + FEW)) + 1


def _parts(rest: np.ndarray, index: Index) -> np.ndarray:
    subspaces, _, width = index.books.shape
    return np.pad(rest, ((0, 0), (0, subspaces * width - rest.shape[1]))).reshape(len(rest), subspaces, width)


def encode(vectors: np.ndarray, lists: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the residuals (rows x subspaces), and the squared distance of each vector from its coded place in each subspace."""
    parts = _parts(vectors - index.centroids[lists], index)
    codes = np.empty(parts.shape[:2], np.uint8)
    error = np.empty(parts.shape[:2])
    for s, book in enumerate(index.books):
        codes[:, s] = _nearest(np.ascontiguousarray(parts[:, s]), book)
        error[:, s] = ((parts[:, s] - book[codes[:, s]]) ** 2).sum(1)
    return codes, error


def decode(codes: np.ndarray, lists: np.ndarray, index: Index) -> np.ndarray:
    """Coded places of vectors."""
    rest = index.books[np.arange(len(index.books)), codes].reshape(len(codes), -1)
    return index.centroids[lists] + rest[:, : index.centroids.shape[1]]


def table_distances(queries: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Squared distances of queries from the coded places of their members, row by row."""
    apart = queries - places
    return np.einsum("ij,ij->i", apart, apart)


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(1, keepdims=True)  # keeps squares in range
    return raw / np.sqrt((raw**2).sum(1, keepdims=True))


def _side_by_side(index: Index, slabs: int) -> Index:
    """The index with its lists in an order in which near lists follow each other."""
    ward = _nearest(index.centroids, _kmeans(index.centroids, slabs, np.random.default_rng(7)))
    return Index(index.centroids[np.argsort(ward, kind="stable")], index.books, index.lead)


def _search(vectors: DataFrame, n: int, threshold: float, per_list: int, most_lists: int) -> DataFrame:
    """(node, links, other): for vectors (node, v, copies) of one length, how many rows they link to, and edges that connect them."""
    spark = vectors.sparkSession
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    low = vectors.withColumn("share", share).where(F.col("share") * n <= 1.25 * (SAMPLE + TEST))  # hardly more than the sample is ranked
    taken = _unit(np.array(list(low.orderBy("share", "node").limit(SAMPLE + TEST).select("v").toPandas()["v"])))
    sample = taken[:SAMPLE]
    lists = max(1, min(most_lists, n // per_list, len(sample) // 8))
    link = np.sqrt(max(2 - 2 * threshold, 0)) + 1e-6
    slabs = -(-n // min(max(n // SLABS, BLOCK), SLAB))
    index = _side_by_side(fit(sample, lists), slabs)
    index.lead = leading(index, taken[-TEST:], link)
    # a list's share of the sample tells its place among the slabs; one of more than a slab goes to several
    size = np.bincount(_nearest(sample, index.centroids), minlength=len(index.centroids)) * (slabs / len(sample))
    shared = spark.sparkContext.broadcast((index, np.cumsum(size) - size, size))  # at most most_lists rows and the code books
    kind = "<f4" if vectors.schema["v"].dataType.elementType.typeName() == "float" else "<f8"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, start, size = shared.value
        for batch in batches:
            if len(batch):
                raw = np.array(list(batch["v"]), kind)
                unit = _unit(raw)
                near = _nearest(unit, index.centroids)
                codes, error = encode(unit, near, index)
                own = (batch["node"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) / float(1 << 24)
                slab = np.minimum(start[near] + size[near] * np.where(size[near] < 1, 0.5, own), slabs - 1).astype(np.int32)
                yield pd.DataFrame({
                    "slab": slab, "lists": near, "nodes": batch["node"], "copies": batch["copies"], "raw": [r.tobytes() for r in raw], "codes": [c.tobytes() for c in codes],
                    "firsts": np.sqrt(error[:, : index.lead].sum(1)), "errors": np.sqrt(error.sum(1))})

    def bind(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lists", kind="stable")
        lists = rows["lists"].to_numpy()
        unit = _unit(np.frombuffer(b"".join(rows["raw"]), kind).reshape(len(rows), -1))
        starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in _ranges(np.flatnonzero(np.diff(lists, prepend=-1)), len(lists))])
        sizes = np.diff(starts, append=len(lists))
        centres = np.add.reduceat(unit, starts) / sizes[:, None]
        radii = np.sqrt(np.maximum.reduceat(((unit - np.repeat(centres, sizes, axis=0)) ** 2).sum(1), starts))
        centre = unit.mean(0)
        radius = float(np.sqrt(((unit - centre) ** 2).sum(1).max()))
        return pd.DataFrame([{
            "slab": rows["slab"].iloc[0], "centre": centre.tolist(), "radius": radius, "raw": b"".join(rows["raw"]), "codes": b"".join(rows["codes"]),
            "starts": starts.astype("<i4").tobytes(), "centres": centres.tobytes(), "radii": radii.tobytes(),
            **{c: rows[c].to_numpy(t).tobytes() for c, t in (("lists", "<i4"), ("nodes", "<i8"), ("copies", "<i8"), ("firsts", "<f8"), ("errors", "<f8"))}}])

    dealt = vectors.select("node", "v", "copies").mapInPandas(assign, "slab int, lists int, nodes long, copies long, raw binary, codes binary, firsts double, errors double")
    columns = ["slab", "centre", "radius", "raw", "codes", "starts", "centres", "radii", "lists", "nodes", "copies", "firsts", "errors"]
    schema = "slab int, centre array<double>, radius double, " + ", ".join(f"{c} binary" for c in columns[3:])
    stored = written(dealt.repartition(slabs, "slab").groupBy("slab").applyInPandas(bind, schema), "slabs")
    # each two slabs that a link can join meet once, every slab about as often on either side; the few rows of a slab's vectors go as one, so nothing is shuffled
    x = stored.select(*[F.col(c).alias("x" + c) for c in columns if c not in ("codes", "lists", "firsts", "errors")])
    y = stored.select(*[F.col(c).alias("y" + c) for c in columns])
    apart = F.aggregate(F.zip_with("xcentre", "ycentre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    once = F.when((F.col("xslab") + F.col("yslab")) % 2 == 0, F.col("xslab") <= F.col("yslab")).otherwise(F.col("xslab") > F.col("yslab"))
    pairs = x.join(y.hint("shuffle_replicate_nl"), once & (F.sqrt(apart) <= F.col("xradius") + F.col("yradius") + link))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, asks = shared.value[0], None
        for batch in batches:
            for row in batch.to_dict("records"):
                has = Side.read({k[1:]: v for k, v in row.items() if k[0] == "y"}, index, kind)
                if asks is None or asks.slab != row["xslab"]:  # the same for many rows
                    asks = Side.read({k[1:]: v for k, v in row.items() if k[0] == "x"}, index, kind)
                yield from _meet(has if has.slab == asks.slab else asks, has, index, threshold, link)

    return written(pairs.drop("xcentre", "ycentre", "xradius", "yradius").mapInPandas(meet, "node long, links long, other long"), "met")


def _ranges(starts: np.ndarray, end: int) -> Iterator[tuple[int, int]]:
    return zip(starts.tolist(), [*starts[1:].tolist(), end], strict=True)


@dataclass
class Side:
    """One slab: its vectors by list, and runs of them (a list or a part of one) with centre and radius."""

    slab: int
    node: np.ndarray
    copies: np.ndarray
    unit: np.ndarray
    starts: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    places: np.ndarray | None = None  # what the codes stand for; asked for on one side only
    first: np.ndarray | None = None  # coding error in the leading subspaces
    error: np.ndarray | None = None

    @staticmethod
    def read(row: dict, index: Index, kind: str) -> Side:
        node = np.frombuffer(row["nodes"], "<i8")
        unit = _unit(np.frombuffer(row["raw"], kind).reshape(len(node), -1))
        radii = np.frombuffer(row["radii"], "<f8")
        side = Side(row["slab"], node, np.frombuffer(row["copies"], "<i8"), unit, np.frombuffer(row["starts"], "<i4"), np.frombuffer(row["centres"], "<f8").reshape(len(radii), -1), radii)
        if "codes" in row:
            codes = np.frombuffer(row["codes"], np.uint8).reshape(len(node), -1)
            side.places = decode(codes, np.frombuffer(row["lists"], "<i4"), index).astype(np.float32)
            side.first, side.error = (np.frombuffer(row[c], "<f8") for c in ("firsts", "errors"))
        return side


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each of ``a`` from each of ``b``."""
    square = (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _meet(asks: Side, has: Side, index: Index, threshold: float, link: float) -> Iterator[pd.DataFrame]:
    """Links between two slabs, or inside one: counts for both sides, and an edge from each linked vector to one of its group."""
    same = asks is has
    n, shift = len(asks.node), 0 if same else len(asks.node)
    counts = np.zeros(shift + len(has.node))
    root = np.arange(len(counts))
    ends = np.append(has.starts[1:], len(has.node))
    open_runs = _far(asks.centres, has.centres) <= asks.radii[:, None] + has.radii + link + 1e-6
    # (x, 1, -xx / 2) by (y, (reach ^ 2 - yy) / 2, 1) is half of what the squared distance leaves of the squared reach
    d = index.dims
    slack = SLACK + 1e-7 * d
    left, right = asks.unit[:, :d], has.places[:, :d].astype(np.float64)
    left = np.column_stack([left, np.ones(n), -(left**2).sum(1) / 2]).astype(np.float32)
    right = np.column_stack([right, ((link + has.first) ** 2 - (right**2).sum(1)) / 2 + slack, np.ones(len(right))]).astype(np.float32)
    reach = ((link + has.error) ** 2 + 2 * slack).astype(np.float32)
    single = asks.unit.astype(np.float32)
    product = np.empty(QUERIES * BLOCK, np.float32)  # used again and again
    for begin in range(0, n, QUERIES):
        stop = min(begin + QUERIES, n)
        first, last = np.searchsorted(asks.starts, [begin, stop - 1], "right")
        runs = np.flatnonzero(open_runs[first - 1 : last].any(0) & (ends > begin if same else True))
        if not len(runs):
            continue
        near = _far(asks.unit[begin:stop], has.centres[runs]) <= link + has.radii[runs] + 1e-6  # a link's other end can't be farther
        runs, near = runs[near.any(0)], near[:, near.any(0)]
        for a, b in _tiles(ends[runs] - has.starts[runs]):
            some = near[:, a:b].any(1)
            rows = np.arange(begin, stop) if some.mean() > 0.75 else begin + np.flatnonzero(some)
            at, to = has.starts[runs[a]], ends[runs[b - 1]]
            cols = slice(at, to) if b - a == runs[b - 1] - runs[a] + 1 else np.concatenate([np.arange(has.starts[r], ends[r]) for r in runs[a:b]])
            members = np.arange(at, to) if isinstance(cols, slice) else cols
            shape = len(rows), len(members)
            lead = np.matmul(left[begin:stop] if len(rows) == stop - begin else left[rows], right[cols].T, out=product[: shape[0] * shape[1]].reshape(shape))
            hit = np.flatnonzero(lead.max(1) >= 0)  # few queries, so only they are looked through
            if not len(hit):
                continue
            rows, hits = rows[hit], lead[hit] >= 0
            if np.count_nonzero(hits) > hits.size // 32:  # a group of near copies
                cosine = asks.unit[rows] @ has.unit[cols].T
                u, v = np.nonzero(cosine >= threshold - 1e-9)
                clear = cosine[u, v] > threshold + 1e-9
            else:
                u, v = np.divmod(np.flatnonzero(hits), shape[1])
                could = table_distances(single[rows[u]], has.places[members[v]]) <= reach[members[v]]
                u, v = u[could], v[could]
                clear = np.zeros(len(u), bool)
            u, v = rows[u], members[v]
            doubt = np.flatnonzero(~clear)
            clear[doubt] = np.einsum("ij,ij->i", asks.unit[u[doubt]], has.unit[v[doubt]]) >= threshold
            if same:
                clear &= u < v
            u, v = u[clear], v[clear]
            if len(u):
                counts += np.bincount(u, has.copies[v], len(counts)) + np.bincount(shift + v, asks.copies[u], len(counts))
                _connect(root, u, shift + v)
    linked = np.flatnonzero(counts)
    if len(linked):
        names = asks.node if same else np.concatenate([asks.node, has.node])
        yield pd.DataFrame({"node": names[linked], "links": counts[linked].astype(np.int64), "other": names[root[linked]]})


def _tiles(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of runs that hold BLOCK members or fewer; no run holds more."""
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held + size > BLOCK and i > begin:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _connect(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the groups of each ``x`` and ``y``; ``root`` holds the least member of each one's group, before and after."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def near_vectors(rows: DataFrame, threshold: float = 0.9, probes: int = 8, per_list: int = 200, most_lists: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows`` (vec_id, embedding).

    Cosine in double precision, links at ``threshold`` or more, all of them: ``probes``, the
    lists once searched for a vector, has no effect any more. Null, zero and empty vectors and those with null
    or non-finite components link with nothing, nor do vectors of different lengths. Equal
    vectors are one node that counts as often as it occurs, so repeated rows and groups
    of copies link with each other. A null vec_id names no component unless all have none.
    The index learns from the ``SAMPLE`` vectors of least hash and holds every vector.
    """
    rows = rows.select("vec_id", "embedding")
    kind = "float" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    v = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # adding 0.0 makes -0.0 and 0.0 one value
    most, least = F.array_max("v"), F.array_min("v")
    good = F.coalesce(~F.array_contains("v", F.lit(float("nan")).cast(kind)) & (most < float("inf")) & (least > float("-inf")) & ((most != 0) | (least != 0)), F.lit(False))  # with a null, array_contains is true or null
    keyed = rows.select("vec_id", v.alias("v")).withColumn("v", F.when(good, F.col("v")))
    keyed = keyed.select("vec_id", "v", *[F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(i), "v")).alias(k) for i, k in enumerate(KEYS)])
    groups = keyed.where("v is not null").groupBy("v", *KEYS).agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    groups = written(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = {r.d: r.n for r in groups.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # lengths in use: few
    met = None
    for d, n in sorted(sizes.items()):
        part = _search(groups.where(F.size("v") == d), n, threshold, per_list, most_lists)
        met = part if met is None else met.union(part)
    if met is None:
        out = keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return out.withColumn("kept", F.lit(True))
    # rows find their vector by two hashes of it, or by itself where two vectors share both
    key = ["v"] if groups.groupBy(*KEYS).count().where("count > 1").take(1) else KEYS
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("a"), F.col("other").alias("b")), "vectors")
    nodes = groups.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = written(nodes.select(*key, "least", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-links")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = nodes.join(least, "root").select(*key, "n_links", "component_id")
    out = keyed.join(known, key, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col(key[0]).isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
