"""Whitening of embeddings: the leading eigenvectors of their covariance, found by slicing its spectrum.

Spark sums the vectors and, in a second pass, the products of the centred vectors; what comes to the driver is
one covariance matrix, whose size is the dimension squared whatever the number of rows.

The number of eigenvalues above a shift is the number of positive pivots of the LDLᵀ factors of the covariance
less the shift (Sylvester's law of inertia). Halving by these counts gives each leading eigenvalue an interval of
its own. Rayleigh quotient iteration inside it converges cubically; a quotient that leaves its interval halves
the interval and starts again. Counts just above and below every eigenvalue found certify its number. Eigenvalues
that no shift can tell apart in double precision are one cluster, whose basis comes from block inverse iteration.

Entries become whole numbers before all else, floor(scale * entry) + base, so the sums are exact and no result
depends on how Spark splits the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch

SCALE, BASE = 64, 1_000_000
# Entries beyond this count as it, so that every whole number and its pieces fit 64 bits.
LARGEST = float(1 << 60)
LOW_BITS = 20
EPS = float(np.finfo(float).eps)
# From Bunch and Parlett: how much larger an off-diagonal entry must be for a pivot of two rows.
ALPHA = (1 + 17**0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric `matrix` are above `shift`: positive pivots of LDLᵀ with complete pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        r = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        p, q = divmod(int(off.argmax()), len(a))
        if diagonal[r] == 0 and off[p, q] == 0:
            break  # what is left is zero: eigenvalues that equal the shift
        if diagonal[r] >= ALPHA * off[p, q]:
            positive += a[r, r] > 0
            column = np.delete(a[:, r], r)
            a = np.delete(np.delete(a, r, 0), r, 1) - np.outer(column, column / a[r, r])
        else:
            positive += 1  # such a pivot of two rows has one eigenvalue of either sign
            two = [p, q]
            columns = np.delete(a[:, two], two, 0)
            a = np.delete(np.delete(a, two, 0), two, 1) - columns @ np.linalg.solve(a[np.ix_(two, two)], columns.T)
    return int(positive)


@dataclass
class Slice:
    """An interval (low, high] with the eigenvalues numbered first to first + count - 1, from the largest down."""

    low: float
    high: float
    first: int
    count: int


def slices(matrix: np.ndarray, wanted: int, tolerance: float) -> list[Slice]:
    """Intervals for the `wanted` largest eigenvalues, each with one of them, or with more if narrower than `tolerance`."""
    reach = np.abs(matrix).sum(1).max() * (1 + 4 * EPS) + tolerance
    open_, done = [Slice(-reach, reach, 1, len(matrix))], []
    while open_:
        s = open_.pop()
        if s.count == 1 or s.high - s.low <= tolerance:
            done.append(s)
        else:
            open_ += halves(matrix, s, wanted)
    return sorted(done, key=lambda s: s.first)


def halves(matrix: np.ndarray, s: Slice, wanted: int) -> list[Slice]:
    """The halves of a slice that hold eigenvalues of a number up to `wanted`."""
    middle = (s.low + s.high) / 2
    upper = min(max(count_above(matrix, middle) - (s.first - 1), 0), s.count)
    both = [Slice(middle, s.high, s.first, upper), Slice(s.low, middle, s.first + upper, s.count - upper)]
    return [h for h in both if h.count and h.first <= wanted]


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray, tolerance: float) -> np.ndarray:
    unit = np.eye(len(matrix))
    for off in (0.0, tolerance, 3 * tolerance):
        try:
            found = np.linalg.solve(matrix - (shift + off) * unit, right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    raise ArithmeticError("no shift near an eigenvalue gives a regular system")


def rayleigh(matrix: np.ndarray, s: Slice, tolerance: float) -> tuple[float, np.ndarray] | None:
    """Eigenvalue and unit vector in a slice of one; None if the iteration leaves the slice."""
    x = np.random.default_rng(len(matrix)).standard_normal(len(matrix))
    x = _solved(matrix, (s.low + s.high) / 2, x, tolerance)
    x /= np.linalg.norm(x)
    best = (np.inf, 0.0, x)
    for _ in range(30):
        image = matrix @ x
        value = float(x @ image)
        if not s.low - tolerance <= value <= s.high + tolerance:
            return None
        residual = float(np.linalg.norm(image - value * x))
        if residual >= best[0]:
            break
        best = (residual, value, x)
        x = _solved(matrix, value, x, tolerance)
        x /= np.linalg.norm(x)
    return (best[1], best[2]) if best[0] <= 100 * tolerance else None


def cluster(matrix: np.ndarray, s: Slice, tolerance: float) -> np.ndarray:
    """Orthonormal columns for a slice of eigenvalues that cannot be told apart."""
    block = np.random.default_rng(len(matrix)).standard_normal((len(matrix), s.count))
    for _ in range(4):
        block, _ = np.linalg.qr(_solved(matrix, (s.low + s.high) / 2, block, tolerance))
    return block


def leading_eigenpairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric positive semi-definite matrix and their unit vectors (columns).

    Eigenvalues that are zero in double precision are left out.
    """
    size = float(np.abs(matrix).max(initial=0))
    if not size:
        return np.zeros(0), np.zeros((len(matrix), 0))
    size = 2.0 ** np.ceil(np.log2(size))  # a power of two, so that dividing by it is exact
    matrix = matrix / size
    tolerance = 4 * EPS * len(matrix) * float(np.abs(matrix).sum(1).max())
    values: list[float] = []
    vectors: list[np.ndarray] = []

    def take(value: float, vector: np.ndarray) -> None:
        for other in vectors:  # vectors of close eigenvalues are orthogonal only after this
            vector = vector - other * (other @ vector)
        values.append(value)
        vectors.append(vector / np.linalg.norm(vector))

    pending = slices(matrix, wanted, tolerance)[::-1]
    while pending:
        s = pending.pop()
        found = rayleigh(matrix, s, tolerance) if s.count == 1 else None
        if found:
            take(*found)
        elif s.high - s.low <= tolerance:
            block = cluster(matrix, s, tolerance)
            for column in block.T:
                take(float(column @ matrix @ column), column)
        else:
            pending += halves(matrix, s, wanted)[::-1]
    values, vectors = values[:wanted], vectors[:wanted]
    apart = 4 * tolerance
    for number, value in enumerate(values, 1):
        if not count_above(matrix, value + apart) < number <= count_above(matrix, value - apart):
            raise ArithmeticError(f"eigenvalue {number} is not certified by the inertia counts")
    kept = [i for i, v in enumerate(values) if v > apart]
    return np.array([values[i] for i in kept]) * size, np.array([vectors[i] for i in kept]).reshape(len(kept), -1).T


@dataclass(frozen=True)
class Whitening:
    """n vectors were fitted, with the sums `sums` of their whole numbers; `directions` are columns over the square roots of `values`."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    directions: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _numbers(column: pa.Array, size: int) -> np.ndarray:
    """floor(SCALE * entry) + BASE of vectors of one size, a row each."""
    entries = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * entries), -LARGEST, LARGEST).astype(np.int64) + BASE


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each size of vectors in the task: size, place, number of vectors, sum of high and of low parts."""
    so_far: dict[int, list] = {}

    def rows() -> pa.RecordBatch:
        columns = [
            [pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n, np.int64)), pa.array(high), pa.array(low)]
            for size, (n, high, low) in so_far.items()
        ]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*columns, strict=True)], names=["size", "place", "n", "high", "low"])

    for batch in batches:
        vectors = batch.column(0)
        sizes = np.diff(vectors.offsets.to_numpy())
        for size in np.unique(sizes[sizes > 0]).tolist():
            numbers = _numbers(vectors.filter(pa.array(sizes == size)), size)
            n, high, low = so_far.get(size, (0, 0, 0))
            so_far[size] = [n + len(numbers), high + (numbers >> LOW_BITS).sum(0), low + (numbers & ((1 << LOW_BITS) - 1)).sum(0)]
        if len(so_far) > 64:
            yield rows()
            so_far = {}
    if so_far:
        yield rows()


@dataclass(frozen=True)
class _Centre:
    """The mean as a whole number near it and a rest, so that centred entries keep full precision."""

    whole: np.ndarray
    rest: np.ndarray
    n: int
    remainder: tuple[int, ...]

    @classmethod
    def of(cls, n: int, sums: tuple[int, ...]) -> _Centre:
        whole = [(2 * s + n) // (2 * n) for s in sums]
        remainder = tuple(s - n * w for s, w in zip(sums, whole, strict=True))
        return cls(np.array(whole, np.int64), np.array([r / n for r in remainder]), n, remainder)

    def apply(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers - self.whole).astype(float) - self.rest

    def deviations(self, numbers: np.ndarray) -> list[int | None]:
        """Sum of (n * number - sum)² of each row, exact; None beyond 64 bits."""
        steps = numbers - self.whole
        largest = np.abs(steps).max(initial=0) * float(self.n) + self.n
        if largest**2 * max(steps.shape[1], 1) < 2.0**62:
            return ((steps * self.n - np.array(self.remainder, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * s - r) ** 2 for s, r in zip(row, self.remainder, strict=True)) for row in steps.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening | None:
    """The whitening of all usable vectors of `df`, repeated ones counted as often as they occur.

    Vectors that are null or hold null or non-finite entries are left out, and so are those that have another
    size than most (the larger size of two as frequent). None if no vector remains. Directions without variance
    are left out, so there can be fewer than `components`.
    """
    vectors = df.select(F.col(vector).cast("array<double>").alias("v")).filter(_usable(F.col("v")))
    parts = scratch(vectors.mapInArrow(_sums, "size int, place int, n bigint, high bigint, low bigint"), "whitening-sums")
    sizes = parts.filter("place = 0").groupBy("size").agg(F.sum("n").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not most:
        return None
    size, n = most[0].size, most[0].n
    wide = T.DecimalType(38, 0)
    totals = parts.filter(F.col("size") == size).groupBy("place").agg(*[F.sum(F.col(c).cast(wide)).alias(c) for c in ("high", "low")])
    sums = tuple((int(r.high) << LOW_BITS) + int(r.low) for r in totals.orderBy("place").collect())
    centre = _Centre.of(n, sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = np.zeros((size, size))
        for batch in batches:
            centred = centre.apply(_numbers(batch.column(0), size))
            so_far += centred.T @ centred
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(so_far[i, j])], names=["i", "j", "product"])

    same = vectors.filter(F.size("v") == size)
    # One row for each pair of places from a task; the driver gets the sums, size * (size + 1) / 2 numbers.
    summed = same.mapInArrow(products, "i int, j int, product double").groupBy("i", "j").agg(F.sum("product").alias("product")).toArrow()
    covariance = np.zeros((size, size))
    i, j, product = (summed.column(c).to_numpy() for c in ("i", "j", "product"))
    covariance[i, j] = covariance[j, i] = product / n
    values, directions = leading_eigenpairs(covariance, min(components, size))
    directions = directions / np.sqrt(values)
    # By linearity this is the covariance of the whitened vectors themselves.
    error = np.abs(directions.T @ covariance @ directions - np.eye(len(values))).max(initial=0)
    return Whitening(n, sums, values, directions, float(np.trace(covariance)), float(error))


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """One row for each usable vector: row (all columns of `df`), deviation and whitened (a number for each component)."""
    size = len(model.sums)
    centre = _Centre.of(model.n, model.sums)
    directions = model.directions
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(_usable(F.col("v")) & (F.size("v") == size))
    schema = T.StructType([rows.schema["row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _numbers(batch.column(1), size)
            whitened = centre.apply(numbers) @ directions
            places = pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * whitened.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(centre.deviations(numbers), pa.int64()), pa.ListArray.from_arrays(places, pa.array(whitened.ravel()))],
                names=["row", "deviation", "whitened"],
            )

    return rows.mapInArrow(project, schema)
