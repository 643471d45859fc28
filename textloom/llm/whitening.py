"""Whitening of vectors by an eigendecomposition that is updated as rows come in.

Each partition keeps the eigenvalues and eigenvectors of its centred scatter. A block of rows is centred and reduced to a
triangle with the same scatter; each row of it, and the step from the old mean to the block's, is a rank-one update:
eigenvalues are the roots of the secular equation between their neighbours, after those that the update leaves alone, or
that coincide, are deflated; eigenvectors follow from update vectors recomputed to fit the roots, which keeps them
orthogonal. Two partitions' spectra combine in the same way, one eigenvector after another, up a tree of tasks. The result
is the basis of a Rayleigh-Ritz step: one more pass sums the scatter of the projected rows, whose eigenvectors turn the
basis into the components.

Entries are whole numbers, so counts and sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stored

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
LARGEST = 1 << 53
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
FAN_IN = 16
EPS = float(np.finfo(float).eps)


def secular_roots(poles: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(squares / (poles - t))``, one above each pole: the nearest pole to each, and what to add to it.

    ``poles`` rise and ``squares`` are positive. Each step replaces the sums left and right of a root by one pole each
    that agrees in value and slope; what leaves the bracket is halved instead.
    """
    m = len(poles)
    upper = np.append(poles[1:], poles[-1] + squares.sum())
    middle = poles + (upper - poles) / 2
    at_middle = 1 + (squares / (poles - middle[:, None])).sum(axis=1)
    origin = np.arange(m) + ((at_middle < 0) & (np.arange(m) < m - 1))
    away = poles - poles[origin][:, None]  # of all poles from each root's origin
    width = upper - poles
    low = np.where(origin > np.arange(m), -width / 2, np.where(at_middle < 0, width / 2, 0.0))
    high = np.where(origin > np.arange(m), 0.0, np.where(at_middle < 0, width, width / 2))
    t = (low + high) / 2
    left_of = np.arange(m) <= np.arange(m)[:, None]
    p = away[np.arange(m), np.arange(m)]
    q = away[np.arange(m), np.minimum(np.arange(m) + 1, m - 1)]
    with np.errstate(all="ignore"):
        for _ in range(80):
            parts = squares / (away - t[:, None])
            slopes = parts / (away - t[:, None])
            left, right = np.where(left_of, parts, 0).sum(axis=1), np.where(left_of, 0, parts).sum(axis=1)
            value = 1 + left + right
            done = np.abs(value) <= EPS * m * (1 + np.abs(left) + np.abs(right))
            low, high = np.where(value < 0, t, low), np.where(value > 0, t, high)
            done |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
            if done.all():
                break
            left_slope, right_slope = np.where(left_of, slopes, 0).sum(axis=1), np.where(left_of, 0, slopes).sum(axis=1)
            s, big = left_slope * (p - t) ** 2, right_slope * (q - t) ** 2
            c = value - left_slope * (p - t) - right_slope * (q - t)
            b, e = c * (p + q) + s + big, c * p * q + s * q + big * p
            root = np.sqrt(np.maximum(b * b - 4 * c * e, 0))
            step = np.where(b > 0, 2 * e / (b + root), (b - root) / (2 * c))
            step[-1] = p[-1] + s[-1] / c[-1]
            inside = np.isfinite(step) & (step > low) & (step < high)
            t = np.where(done, t, np.where(inside, step, (low + high) / 2))
    return origin, t


def rank_one_update(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) after the outer product of ``row`` is added."""
    z = vectors.T @ row
    norm = float(np.sqrt(z @ z))
    if norm == 0 or not np.isfinite(norm):
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    slight = 8 * EPS * max(float(values[-1]), norm * norm)
    active: list[int] = []
    for i in np.flatnonzero(np.abs(z) * norm > slight).tolist():
        if active:
            j = active[-1]
            length = float(np.hypot(z[i], z[j]))
            c, s = z[i] / length, z[j] / length
            if abs((values[i] - values[j]) * c * s) <= slight:  # they coincide: all of the row turns to one of them
                vectors[:, j], vectors[:, i] = c * vectors[:, j] - s * vectors[:, i], s * vectors[:, j] + c * vectors[:, i]
                values[j], values[i] = c * c * values[j] + s * s * values[i], s * s * values[j] + c * c * values[i]
                z[j], z[i] = 0.0, length
                active.pop()
        active.append(i)
    if active:
        kept = np.array(active)
        kept = kept[np.argsort(values[kept], kind="stable")]
        poles, m = values[kept], len(kept)
        origin, t = secular_roots(poles, z[kept] ** 2)
        gaps = (poles[origin][:, None] - poles) + t[:, None]  # root j less pole k
        between = poles[:, None] - poles
        with np.errstate(all="ignore"):
            below = np.where(np.arange(m)[:, None] < np.arange(m), gaps / between, 1)
            above = np.where(np.arange(m - 1)[:, None] >= np.arange(m), gaps[:-1] / between[1:], 1)
        fitted = np.sqrt(np.abs(below.prod(axis=0) * above.prod(axis=0) * gaps[-1])) * np.sign(z[kept])
        turned = fitted / -gaps
        turned /= np.sqrt((turned * turned).sum(axis=1, keepdims=True))
        if np.isfinite(turned).all():
            vectors[:, kept] = vectors[:, kept] @ turned.T
            values[kept] = poles[origin] + t
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean, and eigenvalues and eigenvectors of the centred scatter of some rows."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def none(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def with_rows(self, rows: np.ndarray, n: int, mean: np.ndarray) -> None:
        """Take in ``n`` rows that have the mean and, centred, the scatter of ``rows``."""
        for row in rows:
            self.values, self.vectors = rank_one_update(self.values, self.vectors, row)
        if self.n:
            shift = (mean - self.mean) * np.sqrt(self.n * n / (self.n + n))
            self.values, self.vectors = rank_one_update(self.values, self.vectors, shift)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def with_block(self, block: np.ndarray) -> None:
        mean = block.mean(axis=0)
        self.with_rows(np.linalg.qr(block - mean, mode="r"), len(block), mean)

    def with_spectrum(self, other: Spectrum) -> None:
        if other.n:
            scaled = (other.vectors * np.sqrt(np.maximum(other.values, 0))).T
            self.with_rows(scaled[other.values > 0], other.n, other.mean)


def whole_numbers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """``(numbers, rows)``: ``floor(1024 c) + 100000`` of the vectors of that many finite entries, and their row numbers.

    What is beyond 2^53 either way counts as that.
    """
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(right)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    entries = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(entries).all(axis=1)
    scaled = np.floor(np.clip(entries[finite] * SCALE, -LARGEST, LARGEST))
    return scaled.astype(np.int64) + OFFSET, rows[finite]


def _blocks(frames: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Whole numbers and the rows they belong to, some megabytes at a time."""
    most = max(1, BLOCK_BYTES // (8 * dims))
    for frame in frames:
        for first in range(0, frame.num_rows, most):
            part = frame.slice(first, most)
            numbers, rows = whole_numbers(part.column("__vector"), dims)
            if len(rows):
                yield numbers, part.take(pa.array(rows))


def exact_sums(vectors: DataFrame) -> tuple[int, list[int], int]:
    """``(dims, sums, n)`` of the most frequent dimension (of equally frequent ones the largest): 0 dims without rows."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(d, i, n, Decimal(s)) for d, (n, sums) in found.items() for i, s in enumerate(sums)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
            columns = list(zip(*rows)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["dims", "i", "n", "sum"])

        for frame in frames:
            lengths = pc.list_value_length(frame.column("__vector"))
            for dims in pc.unique(lengths).drop_null().to_pylist():
                for numbers, _ in _blocks(iter([frame]), dims) if dims else ():
                    wide = numbers if np.abs(numbers).max() < LARGEST // len(numbers) else numbers.astype(object)
                    n, sums = found.get(dims, (0, [0] * dims))
                    found[dims] = n + len(numbers), [a + int(b) for a, b in zip(sums, wide.sum(axis=0))]
            if len(found) > 64:
                yield out()
                found.clear()
        yield out()

    sums = vectors.select("__vector").mapInArrow(count, "dims int, i int, n long, sum decimal(38, 0)")
    sums = stored(sums.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")), "sums")
    top = sums.where("i = 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if top is None:
        return 0, [], 0
    own = sums.where(F.col("dims") == top.dims).select("i", "sum").collect()  # one number per dimension
    return top.dims, [int(s) for _, s in sorted(map(tuple, own))], top.n


def _up_a_tree(parts: DataFrame, merge: Callable[[dict, dict], dict], purpose: str) -> dict:
    """The one row that is left after tasks merge up to 16 rows each, level by level.

    Rows are ``(part, n, a, b, c)``, parts being numbered; who merges with whom depends on these numbers alone.
    """
    schema = parts.schema

    def level(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = None
        for frame in frames:
            for row in frame.to_pylist():
                if merged is not None and merged["part"] != row["part"]:
                    yield _batch(merged)
                    merged = None
                merged = row if merged is None else {**merge(merged, row), "part": row["part"]}
        if merged is not None:
            yield _batch(merged)

    current = stored(parts, purpose)
    last = current.agg(F.max("part")).first()[0]
    while last:
        last //= FAN_IN
        nearer = current.withColumn("order", F.col("part")).withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        dealt = nearer.repartitionByRange(last + 1, "part").sortWithinPartitions("part", "order").drop("order")
        current = stored(dealt.mapInArrow(level, schema), purpose)
    return current.first().asDict()


_PART = "part int, n long, a array<double>, b array<double>, c array<double>"


def _part(n: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> dict:
    return {"part": TaskContext.get().partitionId(), "n": n, "a": a.ravel().tolist(), "b": b.ravel().tolist(), "c": c.ravel().tolist()}


def _batch(row: dict) -> pa.RecordBatch:
    doubles = pa.list_(pa.float64())
    kinds = [("part", pa.int32()), ("n", pa.int64()), ("a", doubles), ("b", doubles), ("c", doubles)]
    return pa.RecordBatch.from_pylist([row], pa.schema(kinds))


def combined_spectrum(vectors: DataFrame, dims: int) -> np.ndarray:
    """Eigenvectors (columns, rising eigenvalues) of the centred scatter of all vectors, by rank-one updates alone."""

    def partial(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, held = Spectrum.none(dims), []
        most = max(BLOCK_ROWS, 16 * dims)
        for numbers, _ in _blocks(frames, dims):
            for first in range(0, len(numbers), most):
                held.append(numbers[first : first + most].astype(np.float64))
                if sum(map(len, held)) >= most:
                    spectrum.with_block(np.concatenate(held))
                    held = []
        if held:
            spectrum.with_block(np.concatenate(held))
        if spectrum.n:
            yield _batch(_part(spectrum.n, spectrum.mean, spectrum.values, spectrum.vectors))

    def as_spectrum(row: dict) -> Spectrum:
        return Spectrum(row["n"], np.array(row["a"]), np.array(row["b"]), np.array(row["c"]).reshape(dims, dims))

    def merge(row: dict, other: dict) -> dict:
        spectrum = as_spectrum(row)
        spectrum.with_spectrum(as_spectrum(other))
        flat = {"a": spectrum.mean.tolist(), "b": spectrum.values.tolist(), "c": spectrum.vectors.ravel().tolist()}
        return {"n": spectrum.n, **flat}

    whole = _up_a_tree(vectors.select("__vector").mapInArrow(partial, _PART), merge, "spectra")
    return as_spectrum(whole).vectors


def _added(row: dict, other: dict) -> dict:
    return {"n": row["n"] + other["n"], **{c: np.add(row[c], other[c]).tolist() for c in "abc"}}


def _scatter(vectors: DataFrame, dims: int, turn: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums and products of ``turn(numbers)`` over all vectors: ``(width,)`` and ``(width, width)``."""

    def partial(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(width), np.zeros((width, width))
        for numbers, _ in _blocks(frames, dims):
            turned = turn(numbers)
            n, total, products = n + len(turned), total + turned.sum(axis=0), products + turned.T @ turned
        if n:
            yield _batch(_part(n, total, products, np.zeros(0)))

    whole = _up_a_tree(vectors.select("__vector").mapInArrow(partial, _PART), _added, "scatter")
    return np.array(whole["a"]), np.array(whole["b"]).reshape(width, width), whole["n"]


def deviations(numbers: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """``n x - S``, exactly: in 64 bits where they suffice."""
    if n * int(np.abs(numbers).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return numbers * n - np.array(sums, np.int64)
    return numbers.astype(object) * n - np.array(sums, object)


def _squares(differences: np.ndarray) -> list[Decimal | None]:
    """Sum of the squares of each row; null beyond 38 digits."""
    dims = differences.shape[1]
    if dims * int(np.abs(differences).max(initial=0)) ** 2 < 1 << 63:
        total = (differences * differences).sum(axis=1)
    else:
        wide = differences.astype(object)
        total = (wide * wide).sum(axis=1)
    return [Decimal(v) if v < 10**38 else None for v in total.tolist()]


def _centred(numbers: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    return deviations(numbers, sums, n).astype(np.float64) / n


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` per vector and component.

    Entries c become whole numbers ``x = floor(1024 c) + 100000``. ``n`` vectors are fit; ``deviation`` is the exact sum of
    ``(n x - S)^2`` over the dimensions, S being the sums, as DECIMAL(38, 0), or null if that has more digits. Components are the unit eigenvectors of the
    covariance of x, by falling eigenvalue; ``whitened`` is the centred vector along one over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of the trace. ``identity_error`` is measured on all whitened rows: the largest
    difference of their covariance from the identity.

    Vectors that are null, empty, or hold a null or non-finite entry are dropped, and so are those of another dimension
    than most have (of equally frequent ones the larger counts). There are as many components as dimensions at most.
    Along a component without variance ``whitened`` is null, ``explained`` 0 (null if nothing varies at all), and the
    error is over the others. Equal vectors all count; rows with equal or null keys are vectors of their own; no rows
    give none. Other columns are ignored.
    """
    rows = vectors.select(F.col(key).alias("__key"), F.col(column).alias("__vector"))
    kind = vectors.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, component int, n long, deviation decimal(38, 0), whitened double, explained double, "
        "identity_error double"
    )
    dims, sums, n = exact_sums(rows)
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    basis = combined_spectrum(rows, dims)
    _, products, _ = _scatter(rows, dims, lambda x: _centred(x, sums, n) @ basis, dims)
    values, turn = np.linalg.eigh(products / n)
    trace = float(values.sum())
    own = np.argsort(-values, kind="stable")[: min(components, dims)]
    values, axes = values[own], basis @ turn[:, own]
    varies = values > max(trace, 0) * dims * 16 * EPS
    scaled = axes / np.sqrt(np.where(varies, values, np.inf))
    total, squares, _ = _scatter(rows, dims, lambda x: _centred(x, sums, n) @ scaled, len(own))
    covariance = squares / n - np.outer(total / n, total / n)
    error = float(np.abs(covariance - np.eye(len(own)))[np.ix_(varies, varies)].max(initial=0.0))
    explained = [float(max(v, 0) / trace) if trace > 0 else None for v in values]

    def project(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(own)
        for numbers, part in _blocks(frames, dims):
            differences = deviations(numbers, sums, n)
            whitened = (differences.astype(np.float64) / n) @ scaled
            m = len(whitened)
            each = pa.array(np.repeat(np.arange(m), k))
            missing = np.tile(~varies, m)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("__key").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(_squares(differences), pa.decimal128(38, 0)).take(each),
                    pa.array(whitened.ravel(), mask=missing),
                    pa.array(explained * m, pa.float64()),
                    pa.array(np.full(m * k, error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
