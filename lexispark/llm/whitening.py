"""Whitening of embeddings by a randomised range finder.

Entries are made whole numbers, floor(64 * c) + 1,000,000, so that their sums, the deviations from the mean and the number of
vectors are exact. Random directions, some more than there are components wanted, are multiplied by the covariance again
and again; each such pass reads all vectors, centred before multiplying, and the eigenvectors within the range found
(Rayleigh-Ritz) are taken once their residuals, also against the gaps between eigenvalues, are at rounding level. Where they
don't get there the range is expanded to all dimensions, for which Rayleigh-Ritz is exact.

A pass leaves one matrix of dimensions x directions for each partition; these are added in at most SLOTS tasks, and
the driver adds what these leave. Nothing that grows with the vectors comes to the driver.

Defined cases: rows whose vector is null or holds null or non-finite entries have no result; neither have vectors of
another length than most have (of equally frequent lengths the longest), as they share no covariance; repeated rows count
each; a null id is kept; where the vectors span fewer dimensions than components were asked for there are only as
many; no vectors or vectors that are all equal give no rows; extra columns are ignored. Entries beyond 2**40 and
deviations that don't fit a long are errors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the whole-number form.
SCALE, SHIFT = 64, 1_000_000
#: Directions besides those wanted, passes before the range is expanded, and tasks that add what partitions leave.
OVERSAMPLE, PASSES, SLOTS = 16, 6, 64
#: Residuals, as parts of the largest eigenvalue and of the gap to the next one, that count as none.
RESIDUAL, ANGLE = 1e-14, 1e-12
_EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    """What was fitted. sums are exact; components are columns, by falling eigenvalue; passes counts those over all vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    passes: int
    expanded: bool
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of x."""
        return self.centred(x) @ self.components / np.sqrt(self.values)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once."""
    return (x - sums // n) - (sums % n) / n


def whole_numbers(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that count, their entries as whole numbers) of a column of lists."""
    sizes = np.diff(column.offsets.to_numpy())
    valid = np.ones(len(column), bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum()))
    entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    fine = np.isfinite(entries)
    if flat.null_count:
        fine &= flat.is_valid().to_numpy(zero_copy_only=False)
    bad = np.bincount(np.repeat(np.arange(len(column)), sizes)[~fine], minlength=len(column))
    rows = np.flatnonzero(valid & (sizes == dimension) & (bad == 0))
    starts = np.cumsum(sizes) - sizes
    entries = entries[starts[rows][:, None] + np.arange(dimension)]
    if len(entries) and np.abs(entries).max() > 2.0**40:
        raise ValueError("an entry of a vector is beyond 2**40")
    return rows, np.floor(entries * SCALE).astype(np.int64) + SHIFT


def _total(vectors: DataFrame, dimension: int, kernel: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: type) -> np.ndarray:
    """The sum of ``kernel`` over all vectors, by batches, partitions, tasks, and at last here."""

    def add(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for part in parts:
            total += part
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(kernel(whole_numbers(b.column(0), dimension)[1]) for b in batches)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(np.frombuffer(p.as_py(), kind).reshape(shape) for b in batches for p in b.column(0))

    parts = vectors.mapInArrow(partial, "part binary")
    slots = min(SLOTS, math.isqrt(vectors.rdd.getNumPartitions()))
    if slots > 1:
        parts = parts.repartition(slots).mapInArrow(united, "part binary")
    return sum((np.frombuffer(r[0], kind).reshape(shape) for r in parts.toLocalIterator()), np.zeros(shape, kind))


def _vectors(frame: DataFrame, vec_col: str) -> DataFrame:
    return frame.select(F.col(vec_col).cast("array<double>").alias("vector"))


def _dimension(frame: DataFrame, vec_col: str) -> tuple[int, int]:
    """(length that most vectors have, how many these are)."""
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sizes = _vectors(frame, vec_col).filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad).groupBy(F.size("vector").alias("size")).count()
    found = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return (found["size"], found["count"]) if found else (0, 0)


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, vectors, norms of the residuals) of V within the range of the orthonormal q, by V q."""
    inner = q.T @ vq
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return values, vectors, np.linalg.norm(vq @ turn - vectors * values, axis=0)


def _settled(values: np.ndarray, residuals: np.ndarray, k: int) -> float:
    """How far the first k are from what counts as converged; 1 or less is converged."""
    gaps = np.abs(np.diff(values))
    gap = np.minimum(np.append(np.inf, gaps), np.append(gaps, np.inf))[:k]
    top = max(values[0], np.finfo(float).tiny)
    wanted = residuals[:k]
    return float(max((wanted / (RESIDUAL * len(values) * top)).max(), (wanted / np.maximum(gap * ANGLE, _EPS * top)).max()))


def fit(frame: DataFrame, vec_col: str = "embedding", components: int = 32, seed: int = 13) -> Whitening | None:
    """The first ``components`` principal components of all vectors; None if there are no vectors."""
    d, n = _dimension(frame, vec_col)
    if not n:
        return None
    vectors = _vectors(frame, vec_col)
    k = min(components, d)
    sums = _exact_sums(vectors, d)
    def times(q: np.ndarray) -> np.ndarray:
        """V q."""

        def kernel(x: np.ndarray) -> np.ndarray:
            moved = centred(x, n, sums)
            return moved.T @ (moved @ q)

        return _total(vectors, d, kernel, q.shape, np.float64) / n

    trace = float(_total(vectors, d, lambda x: np.square(centred(x, n, sums)).sum(0), (d,), np.float64).sum()) / n
    wide, passes, expanded = min(d, k + OVERSAMPLE), 2, False
    q = np.eye(d) if wide == d else np.linalg.qr(np.random.default_rng(seed).standard_normal((d, wide)))[0]
    before = None
    while True:
        vq = times(q)
        passes += 1
        values, found, residuals = _ritz(q, vq)
        far = _settled(values, residuals, k)
        if q.shape[1] == d or far <= 1:
            break
        # What the passes that are left would bring, by what the last one did.
        left = PASSES + 2 - passes
        if left <= 0 or (before is not None and far * (far / before) ** left > 1):
            q, expanded = np.eye(d), True
            continue
        before = far
        q = np.linalg.qr(vq)[0]
    real = int((values[:k] > 64 * d * _EPS * max(values[0], 0)).sum()) if values[0] > 0 else 0
    out = Whitening(n, sums, values[:real].copy(), found[:, :real].copy(), trace, passes, expanded, 0.0)
    return _measured(out, vectors, d) if real else out


def _exact_sums(vectors: DataFrame, d: int) -> np.ndarray:
    """Sums as whole numbers of any size, by halves of 32 bits that can't overflow."""
    halves = _total(vectors, d, lambda x: np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]), (2, d), np.int64)
    exact = [(int(a) << 32) + int(b) for a, b in halves.T]
    if max(map(abs, exact)) >= 1 << 61:
        raise OverflowError("the sums of the vectors don't fit a long")
    return np.array(exact, np.int64)


def _measured(found: Whitening, vectors: DataFrame, d: int) -> Whitening:
    """``found`` with the largest entry of the whitened vectors' covariance minus the identity, over all vectors."""
    k = len(found.values)
    middle = _total(vectors, d, lambda x: found.project(x).sum(0), (k,), np.float64) / found.n

    def kernel(x: np.ndarray) -> np.ndarray:
        moved = found.project(x) - middle
        return moved.T @ moved

    error = float(np.abs(_total(vectors, d, kernel, (k, k), np.float64) / found.n - np.eye(k)).max())
    return Whitening(found.n, found.sums, found.values, found.components, found.trace, found.passes + 2, found.expanded, error)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The exact sums of squares of the rows of n * x - sums."""
    moved = x - sums // n
    if n * int(np.abs(moved).max(initial=0)) >= 1 << 61:
        raise OverflowError("a deviation doesn't fit a long")
    moved = n * moved - sums % n
    if int(np.abs(moved).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
        return np.square(moved).sum(1)
    exact = [sum(v * v for v in row) for row in moved.tolist()]
    if max(exact) >= 1 << 63:
        raise OverflowError("a deviation doesn't fit a long")
    return np.array(exact, np.int64)


def whiten(frame: DataFrame, found: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of each vector and component."""
    id_type = frame.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("n", "deviation")), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    k = 0 if found is None else len(found.values)
    if not k:
        return frame.sparkSession.createDataFrame([], schema)
    d = len(found.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_numbers(batch.column(1), d)
            if not len(rows):
                continue
            white = found.project(x)
            each = np.repeat(np.arange(len(rows)), k)
            columns = [
                batch.column(0).take(pa.array(rows[each])),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(len(each), found.n, np.int64)),
                pa.array(deviations(x, found.n, found.sums)[each]),
                pa.array(white.ravel()),
                pa.array(np.tile(found.values / found.trace, len(rows))),
                pa.array(np.full(len(each), found.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.select(F.col(id_col), F.col(vec_col).cast("array<double>").alias("__vector")).mapInArrow(run, schema)


def whitened(frame: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """Fits on all vectors of ``frame`` and whitens them."""
    return whiten(frame, fit(frame, vec_col, components), id_col, vec_col)
