"""Embedding whitening by Chebyshev-filtered subspace iteration (operator 12).

The leading eigenvectors of the covariance V of all distinct vectors are found without forming V.
The only thing done with the table is a pass: every task sums X'XQ of its centred rows X for a thin
matrix Q of a few columns, and the sums of all tasks are added up. A round takes the block Q through
the Chebyshev polynomial of some degree, one pass per degree by the three-term recurrence, scaled so
that it stays small on the unwanted part of the spectrum, between a bound from a short Lanczos run
and the smallest Ritz value of the block, and grows fast above it. QR and Rayleigh-Ritz follow on
the driver, on matrices of dimension x block. Rounds end once the residuals of the wanted pairs
certify them, as far as double precision lets them.

Vectors are fixed-point: an entry c counts as floor(256 c), so equal vectors are told exactly, and
sums and deviations are exact integers.

Defined cases: vectors that are null or hold null or non-finite entries go; the dimension is the
length that most of the others have (of equally many the smaller), and vectors of other lengths, or
of none, go too; a null id is an id like others, and repeated rows are all returned, though the fit
counts each distinct vector once; where the covariance has no variance left for a component, its
whitened value is null; a deviation beyond 64 bits is null; an empty table gives no rows; other
columns are ignored. Memory: a batch of vectors, and dimension x block numbers on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumencat.sources.storage import materialize

SCALE = 256
COMPONENTS = 4
#: Columns of the block beyond the components that are wanted: the more, the faster it converges.
GUARD = 28
#: Most passes of a round, its largest amplification, and Lanczos steps for the edges of the spectrum.
DEGREE, AMPLIFY, STEPS = 12, 1e10, 10
#: A pair is certified by a residual of EXACT times its eigenvalue; if all are under GOOD times the
#: largest one, rounds also end when they improve no more, as rounding then is all that is left.
EXACT, GOOD, MOST_ROUNDS = 1e-14, 1e-11, 60
SEED = 12


@dataclass
class Whitening:
    n: int  # distinct vectors
    sums: list[int]  # exact, per dimension
    mean: np.ndarray
    components: np.ndarray  # dimension x components, unit columns
    eigenvalues: np.ndarray
    trace: float
    residual: float  # largest of the wanted pairs, each as a share of its eigenvalue
    passes: int
    identity_error: float | None = None


def fixed_point(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``rows`` with ``x``, the usable vectors as whole numbers, in place of ``vector``."""
    usable = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(math.inf)))
    rows = rows.where(F.col(vector).isNotNull() & usable & (F.size(vector) > 0))
    return rows.select(*[c for c in rows.columns if c not in (vector, "x")], F.transform(vector, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _exact_sums(fit: DataFrame, size: int) -> list[int]:
    """The exact sum of each dimension: halves of 32 bits are summed apart, so nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = [0] * size, [0] * size
        for batch in batches:
            x = _matrix(batch.column(0), size)
            high = [a + b for a, b in zip(high, (x >> 32).sum(axis=0).tolist())]
            low = [a + b for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0).tolist())]
        total = [(a << 32) + b for a, b in zip(high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["i", "s"])

    rows = fit.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows)]


def _summed(fit: DataFrame, mean: np.ndarray, of: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum over all centred rows X of ``of(X)``, a matrix: one pass over the table."""
    size, names = len(mean), [f"c{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in batches:
            total += of(_matrix(batch.column(0), size) - mean)
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *map(pa.array, total.T.copy())], ["i", *names])

    sums = fit.select("x").mapInArrow(run, f"i int, {', '.join(f'{c} double' for c in names)}")
    rows = sums.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return np.array([r[1:] for r in sorted(rows)], np.float64).reshape(height, width)


def _lanczos(times: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int) -> float:
    """A lower edge of the spectrum: the smallest Ritz value of a short run, less its last residual."""
    basis, alpha, beta = [start / np.linalg.norm(start)], [], []
    for _ in range(min(steps, len(start))):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(float(basis[-1] @ w))
        for _ in range(2):
            for v in basis:
                w = w - (v @ w) * v
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * abs(alpha[0]):
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beta[-1])


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """The block after the Chebyshev polynomial that is small on [low, high], scaled to 1 at ``top``.

    ``vq`` is the first product, which the step before has made already.
    """
    centre, half = (low + high) / 2, (high - low) / 2
    growth = math.acosh(max((top - centre) / half, 1 + 1e-12))
    degree = max(1, min(DEGREE, int(math.log(AMPLIFY) / growth)))
    first = half / (top - centre)
    ratio = first
    before, block = q, (vq - centre * q) * (ratio / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - ratio)
        before, block = block, 2 * (following / half) * (times(block) - centre * block) - ratio * following * before
        ratio = following
    return block


def _eigenpairs(times: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, guard: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, vectors, residual) of the ``wanted`` largest pairs, by falling eigenvalue."""
    rng = np.random.default_rng(SEED)
    width = min(size, wanted + guard)
    q = np.eye(size) if width == size else np.linalg.qr(rng.normal(size=(size, width)))[0]
    low = 0.0 if width == size else _lanczos(times, rng.normal(size=size), STEPS)
    best, stalls = None, 0
    for _ in range(MOST_ROUNDS):
        vq = times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top, high = max(float(values[0]), 0.0), float(values[-1])
        norms = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        residual = float((norms / np.maximum(values[:wanted], 1e-15 * top + 1e-300)).max())
        stalls = stalls + 1 if best is not None and residual > best[2] / 2 else 0
        if best is None or residual <= best[2]:
            best = values[:wanted], q[:, :wanted], residual
        if width == size or residual <= EXACT or (stalls > 1 and norms.max() <= GOOD * top) or high <= 1e-15 * top:
            break
        if stalls or low >= high:
            low = 0.0  # always a bound, if a slower one
        q = np.linalg.qr(_filtered(times, q, vq, low, high, top))[0]
    return best


def fit(rows: DataFrame, components: int = COMPONENTS, guard: int = GUARD) -> Whitening | None:
    """The whitening of ``rows`` (x, from ``fixed_point``); None without a vector.

    The number of dimensions bounds all that comes to the driver.
    """
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return None
    size = lengths["size"]
    fitted = materialize(rows.where(F.size("x") == size).select("x").distinct(), "fit")
    n, sums = fitted.count(), _exact_sums(fitted, size)
    mean = np.array([s / n for s in sums])
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return _summed(fitted, mean, lambda x: x.T @ (x @ q), *q.shape) / n

    trace = float(_summed(fitted, mean, lambda x: (x * x).sum(axis=0)[:, None], size, 1).sum()) / n
    values, vectors, residual = _eigenpairs(times, size, min(components, size), guard)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    values = np.where(values > 1e-13 * size * trace, values, 0.0)
    model = Whitening(n, sums, mean, vectors, values, trace, residual, passes)
    kept = values > 0
    if kept.any():
        to, k = model.components[:, kept] / np.sqrt(values[kept]), int(kept.sum())

        def moments(x: np.ndarray) -> np.ndarray:
            w = x @ to
            return np.concatenate([w.T @ w, w.sum(axis=0)[None]])

        found = _summed(fitted, mean, moments, k + 1, k) / n
        model.identity_error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return model


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """The exact sum of (n x - S)^2 over the dimensions."""
    size = x.shape[1]
    reach = model.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, model.sums))
    if size * reach * reach < 1 << 63:
        apart = model.n * x - np.array(model.sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = (sum((model.n * c - s) ** 2 for c, s in zip(row, model.sums)) for row in x.tolist())
    return [d if d < 1 << 63 else None for d in exact]


def transform(rows: DataFrame, model: Whitening | None, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row of ``rows`` (key, x)."""
    kind = rows.schema[key].dataType.simpleString()
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select(F.col(key).alias("key"), "x")
    if model is None:
        return rows.select("key").where("false").sparkSession.createDataFrame([], f"`{key}` {kind}, {schema}")
    size, k = model.components.shape
    usable = model.eigenvalues > 0
    to = model.components / np.sqrt(np.where(usable, model.eigenvalues, 1.0))
    explained = [float(e) / model.trace if model.trace else None for e in model.eigenvalues]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, times = _matrix(batch.column(1), size), batch.num_rows
            white = pa.array(((x - model.mean) @ to).ravel(), mask=np.tile(~usable, times))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(times), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), times)),
                pa.array(np.full(times * k, model.n)),
                pa.array([d for d in _deviations(x, model) for _ in range(k)], pa.int64()),
                white, pa.array(explained * times, pa.float64()), pa.array([model.identity_error] * (times * k), pa.float64()),
            ], ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == size).mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors of ``rows`` and whiten every one of them."""
    usable = fixed_point(rows.select(key, vector), vector)
    return transform(usable, fit(usable, components), key)
