"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

X is the table of centred whole-number vectors, one row each. The bidiagonalisation
X V = U B alternates products X v and X'u. A left vector is as long as the table, but it
is always X c for a short vector c that the recurrence carries along, so a step is one
pass in which each task forms its part of u = X w and of X'u; a step sums to d + 2 numbers
and leaves nothing behind that a lost executor could take away. The inner products with
earlier left vectors follow from X'u of those, so both sides are reorthogonalised against
all earlier vectors. The singular values of the small B give the deviations, V times its
right vectors the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermetrics.session import written

SCALE, SHIFT = 1024, 100_000
#: A component whose deviation is below this part of the largest has none.
SMALLEST = 1e-8
_LARGEST = float(1 << 52)
_LONG = (1 << 63) - 1


# vectors as blocks -----------------------------------------------------------------------


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    """(ids, data): up to 4096 vectors a row, their whole numbers before SHIFT in 4 or 8 bytes each."""
    schema = f"ids array<{rows.schema['vec_id'].dataType.simpleString()}>, width int, data binary"
    per_row = max(1, min(4096, (8 << 20) // (8 * dims)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            whole = np.floor(values * SCALE).astype(np.int64)
            for at in range(0, len(whole), per_row):
                part = whole[at : at + per_row]
                width = 4 if np.abs(part).max() < 1 << 31 else 8
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids.slice(at, len(part))),
                    pa.array([width], pa.int32()), pa.array([part.astype(f"<i{width}").tobytes()], pa.binary())], ["ids", "width", "data"])

    return written(rows.mapInArrow(packed, schema), "vectors")


def _read(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array | None, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            width, data = batch.column("width")[i].as_py(), batch.column("data")[i].as_py()
            ids = batch.column("ids")[i].values if "ids" in batch.schema.names else None
            yield ids, np.frombuffer(data, f"<i{width}").reshape(-1, dims).astype(np.int64)


def _summed(blocks: DataFrame, dims: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` (``size`` doubles of a block of vectors) over all blocks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, whole in _read(batches, dims):
            total += part(whole)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "v"])

    found = blocks.select("width", "data").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for at, v in found.collect():  # at most ``size`` rows, however many vectors
        out[at] = v
    return out


def _totals(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dims + 1)
        for _, whole in _read(batches, dims):
            high, low = (whole >> 26).sum(axis=0), (whole & ((1 << 26) - 1)).sum(axis=0)
            for i in range(dims):
                total[i] += (int(high[i]) << 26) + int(low[i])
            total[dims] += len(whole)
        at = pa.array(np.arange(dims + 1, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([at, pa.array([str(x) for x in total])], ["at", "v"])

    found = blocks.select("width", "data").mapInArrow(sums, "at int, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = [0] * (dims + 1)
    for at, v in found.collect():
        out[at] = int(v)
    return out[dims], out[:dims]


# bidiagonalisation -----------------------------------------------------------------------


def _without(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``x`` less its part in the span of orthonormal columns; twice is enough."""
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


Product = Callable[[np.ndarray], tuple[np.ndarray, float]]


def bidiagonal(product: Product, start: np.ndarray, locked: np.ndarray, wanted: int, nothing: float, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray, bool]:
    """Singular values and right vectors of X beside the ``locked`` ones: (values, vectors, whole).

    ``product(w)`` returns X'u and the squared length of u for u = X w. Ends when the ``wanted`` largest have converged, when all
    values are surely below ``floor``, or with ``whole`` when the vectors reached span an
    invariant space; then all of them are returned. Lengths up to ``nothing`` are rounding errors.
    """
    dims = len(start)
    start = _without(start, locked)
    right, short, back = [start / np.linalg.norm(start)], [], []
    alphas: list[float] = []
    betas: list[float] = []

    def small(last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """SVD of B, with the column of the last beta or without."""
        b = np.zeros((len(alphas), len(alphas) + last))
        for i, alpha in enumerate(alphas):
            b[i, i] = alpha
            if i + 1 < b.shape[1]:
                b[i, i + 1] = betas[i]
        left, values, across = np.linalg.svd(b, full_matrices=False)
        return left, values, np.column_stack(right[: b.shape[1]]) @ across.T

    while True:
        w = right[-1] - (betas[-1] * short[-1] if short else 0.0)
        for _ in range(3):
            g, size = product(w)
            if not short or size <= 0:
                break
            h = np.array([b @ w for b in back])
            w, g = w - np.column_stack(short) @ h, g - np.column_stack(back) @ h
            if h @ h <= 1e-4 * size:
                size -= float(h @ h)
                break
        if size <= nothing * nothing:
            if not alphas:
                return np.zeros(0), np.zeros((dims, 0)), True
            _, values, vectors = small(last=True)
            return values, vectors, True
        alpha = float(np.sqrt(size))
        short.append(w / alpha)
        back.append(g / alpha)
        alphas.append(alpha)
        r = _without(_without(back[-1] - alpha * right[-1], np.column_stack(right)), locked)
        betas.append(float(np.linalg.norm(r)))
        left, values, vectors = small()
        if len(alphas) + locked.shape[1] == dims or betas[-1] <= nothing:
            return values, vectors, True
        misses = betas[-1] * np.abs(left[-1])
        if floor and len(alphas) > 2 and values[0] + 10 * misses[0] < floor:
            return values[:1], vectors[:, :1], False
        if len(values) > wanted:
            gaps = np.minimum(np.abs(np.diff(values, prepend=np.inf)), np.abs(np.diff(values, append=0.0)))
            if (misses[:wanted] <= 1e-15 * gaps[:wanted]).all():
                return values[:wanted], vectors[:, :wanted], False
        right.append(r / betas[-1])


def leading(product: Product, dims: int, wanted: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values of X, whose squares sum to ``spread``, and their right vectors; none for a value of zero.

    One start vector meets one vector of each repeated value only. So once values have
    converged, a further sequence runs beside their vectors until it is sure that nothing
    larger was missed; what it finds is locked too.
    """
    random = np.random.default_rng(7)
    values, vectors = np.zeros(0), np.zeros((dims, 0))
    while vectors.shape[1] < dims:
        floor = float(np.sort(values)[-wanted]) if len(values) >= wanted else 0.0
        found, across, whole = bidiagonal(product, random.standard_normal(dims), vectors, min(wanted, dims - vectors.shape[1]), 1e-12 * np.sqrt(spread), floor)
        if not len(found) or (not whole and found[0] < floor):
            break
        values, vectors = np.concatenate([values, found]), np.column_stack([vectors, across])
    order = np.argsort(-values, kind="stable")[:wanted]
    order = order[values[order] > SMALLEST * values.max(initial=0.0)]
    return values[order], vectors[:, order]


# operator --------------------------------------------------------------------------------


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): rows whose vector and entries are there, finite and small enough for a long."""
    v = F.col(column).cast("array<double>")
    # a comparison with null is null, one with NaN (greater than all) false
    return vectors.select("vec_id", v.alias("v")).where(F.forall("v", lambda x: F.coalesce(F.abs(x) < _LARGEST, F.lit(False))))


def whitened(vectors: DataFrame, components: int = 8, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable vector and component.

    Vectors that are null, hold null or non-finite entries, or entries beyond 2^52 are left
    out, as are vectors of another length than most have (of equally many: the longest).
    Repeated rows and null vec_ids count as rows. Directions without deviation
    are no components: constant vectors, one vector, empty vectors or an empty table give no
    rows, fewer dimensions than ``components`` fewer of them. A ``deviation`` beyond a long is null. Other columns
    are not returned.
    """
    good = usable(vectors, column)
    schema = f"vec_id {good.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    most = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    nothing = vectors.sparkSession.createDataFrame([], schema)
    if most is None or not most["d"]:
        return nothing
    dims = int(most["d"])
    blocks = _blocks(good.where(F.size("v") == dims), dims)
    n, sums = _totals(blocks, dims)
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([float(Fraction(s - n * (s // n), n)) for s in sums])

    def centred(whole: np.ndarray) -> np.ndarray:
        return (whole - base).astype(np.float64) - rest

    def product(w: np.ndarray) -> tuple[np.ndarray, float]:
        def part(whole: np.ndarray) -> np.ndarray:
            x = centred(whole)
            u = x @ w
            return np.append(x.T @ u, u @ u)

        found = _summed(blocks, dims, dims + 1, part)
        return found[:-1], float(found[-1])

    spread = float(_summed(blocks, dims, 1, lambda whole: np.array([np.square(centred(whole)).sum()]))[0])
    if spread <= 0:
        return nothing
    values, across = leading(product, dims, components, spread)
    k = len(values)
    scaled = across * (np.sqrt(n) / values)

    def moments(whole: np.ndarray) -> np.ndarray:
        w = centred(whole) @ scaled
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    found = _summed(blocks, dims, k * k + k, moments) / n
    covariance = found[: k * k].reshape(k, k) - np.outer(found[k * k :], found[k * k :])
    error, explained = float(np.abs(covariance - np.eye(k)).max()), values**2 / spread

    def deviations(whole: np.ndarray) -> pa.Array:
        about = np.square((whole - base).astype(np.float64) * n - np.array([float(s - n * int(b)) for s, b in zip(sums, base, strict=True)])).sum(axis=1)
        rows: list[int | None] = []
        exact = np.array([s - n * int(b) for s, b in zip(sums, base, strict=True)], np.int64)
        fits = about < 4e18
        quick = np.square((whole[fits] - base) * n - exact).sum(axis=1) if fits.any() else np.zeros(0, np.int64)
        quick_at = iter(quick.tolist())
        for i, ok in enumerate(fits):
            if ok:
                rows.append(next(quick_at))
            else:
                total = sum((n * int(x) - s) ** 2 for x, s in zip(whole[i], sums, strict=True))
                rows.append(total if total <= _LONG else None)
        return pa.array(rows, pa.int64())

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, whole in _read(batches, dims):
            w, m = centred(whole) @ scaled, len(whole)
            row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                ids.take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                deviations(whole).take(row), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(projected, schema)
