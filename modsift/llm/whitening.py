"""Whitening of embeddings by a polarisation covariance.

Entries become whole numbers, so every sum below is exact.  The fit list holds each distinct vector once.  With the
means known, one aggregate takes the squared centred values of every dimension and of every sum of two dimensions:
    2 cov(i, j) = var(i + j) - var(i) - var(j),
so the differences of these variances are all cross-covariances, and the matrix assembled from them goes to eigh.
Tasks send only their dims * (dims + 1) / 2 sums; the driver holds that many numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsift.llm.common import bounded_batches, written
from modsift.llm.vectors import LIMB_COLUMNS, common_length, finite_vectors, floored, limb_batch, summed_limbs

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
MOST = 1 << 60  # floor(64 * entry) is held inside +-MOST, so that x is a long for every finite entry
SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """Exact fit (n, sums) and components by falling eigenvalue; ``vectors`` has one column per component."""

    length: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace else None for v in self.values]

    @property
    def scales(self) -> np.ndarray:
        """sqrt of the eigenvalues; NaN where one is zero to double precision and nothing can be whitened."""
        least = self.length * np.finfo(float).eps * max(self.values, default=0.0)
        return np.sqrt(np.where(self.values > least, self.values, np.nan))


def whole_numbers(matrix: np.ndarray) -> np.ndarray:
    return floored(matrix, SCALE, MOST) + SHIFT


def _wide(x: np.ndarray, most: int, terms: int) -> np.ndarray:
    """int64 where ``terms`` squares of up to ``most`` stay inside a long, else Python's whole numbers."""
    return x if most * most * max(terms, 1) < SAFE else x.astype(object)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact."""
    middle = [round(s / n) if abs(s) < 1 << 53 else s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    y = _less(x, middle)
    most = max((abs(int(v)) for v in (y.min(initial=0), y.max(initial=0))), default=0) * n + max(map(abs, rest), default=0)
    if most >= SAFE:
        return y.astype(object) * n - np.array(rest, object)
    return y.astype(np.int64) * n - np.array(rest, np.int64)


def _less(x: np.ndarray, middle: list[int]) -> np.ndarray:
    big = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0) + max(map(abs, middle), default=0)
    return x - np.array(middle, np.int64) if big < SAFE else x.astype(object) - np.array(middle, object)


def _packed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, matrix = finite_vectors(batch.column(0), length)
            rows = [r.tobytes() for r in whole_numbers(matrix).astype("<i8")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])

    return run


def _unpacked(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, length).astype(np.int64)


def _count_and_sums(length: int):
    def run(batches):
        total = [0] * (length + 1)
        for batch in batches:
            x = _unpacked(batch, length)
            wide = x if np.abs(x).max(initial=0) < (1 << 62) // max(len(x), 1) else x.astype(object)
            for i, v in enumerate([len(x), *wide.sum(axis=0).tolist()]):
                total[i] += v
        yield limb_batch(total)

    return run


def _squares(length: int, middle: list[int]):
    """Sums of squares of the centred values of every dimension, then of every sum of two dimensions (i < j)."""

    def run(batches):
        total = [0] * (length * (length + 1) // 2)
        for batch in batches:
            y = _less(_unpacked(batch, length), middle)
            y = _wide(y, 2 * max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0)))), len(y))
            found = (y * y).sum(axis=0).tolist()
            for i in range(length - 1):
                both = y[:, i : i + 1] + y[:, i + 1 :]
                found += (both * both).sum(axis=0).tolist()
            total = [a + b for a, b in zip(total, found)]
        yield limb_batch(total)

    return run


def polarised_covariance(squares: list[int], rest: list[int], n: int) -> np.ndarray:
    """Covariance matrix (divisor n) from the sums of squares around whole-number middles.

    The mean of dimension i lies rest[i] / n above its middle; n * square - rest**2 is n**2 times the variance, exactly.
    """
    length = len(rest)
    single = [n * squares[i] - rest[i] ** 2 for i in range(length)]
    matrix, at = np.empty((length, length)), length
    for i in range(length):
        matrix[i, i] = single[i] / n**2
        for j in range(i + 1, length):
            of_sum = n * squares[at] - (rest[i] + rest[j]) ** 2
            matrix[i, j] = matrix[j, i] = (of_sum - single[i] - single[j]) / (2 * n**2)
            at += 1
    return matrix


def _spread(model: Whitening, components: int):
    """Sums of the whitened values and of their products, one row of numbers a task."""

    def run(batches):
        total, ones = np.zeros((components + 1, components + 1)), None
        for batch in batches:
            z = np.nan_to_num(_whitened(_unpacked(batch, model.length), model, components)[0])
            ones = np.hstack([z, np.ones((len(z), 1))])
            total += ones.T @ ones
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["k", "v"])

    return run


def _whitened(x: np.ndarray, model: Whitening, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Whitened values (rows x components) and n * x - sums."""
    centred = _centred(x, model.n, model.sums)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (centred.astype(float) / model.n) @ model.vectors[:, :components] / model.scales[:components], centred


def fit_whitening(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows``; None if no vector takes part.

    Vectors that are null, hold null or non-finite entries or differ from the commonest length take no part.
    ``identity_error`` is measured on the fit list, over the components that can be whitened.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    length = common_length(rows, vector)
    if not length:
        return None
    fit = written(rows.select(vector).mapInArrow(_packed(length), "x binary").distinct(), "fit-vectors")
    n, *sums = summed_limbs(fit.mapInArrow(_count_and_sums(length), LIMB_COLUMNS), length + 1)
    if not n:
        return None
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    squares = summed_limbs(fit.mapInArrow(_squares(length, middle), LIMB_COLUMNS), length * (length + 1) // 2)
    covariance = polarised_covariance(squares, rest, n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(length)] < 0, -1.0, 1.0)  # largest entry positive
    model = Whitening(length, n, tuple(sums), values, vectors * signs, float(np.trace(covariance)))
    used = min(components, length)
    found = fit.mapInArrow(_spread(model, used), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    spread = np.array([r.v for r in found]).reshape(used + 1, used + 1)
    good = np.isfinite(model.scales[:used])
    mean = spread[:used, used] / n
    off = np.abs(spread[:used, :used] / n - np.outer(mean, mean) - np.eye(used))[np.ix_(good, good)]
    return replace(model, identity_error=float(off.max()) if off.size else None)


def whiten(rows: DataFrame, model: Whitening | None, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The rows that take part, with ``whitened`` (array of up to ``components`` numbers) and ``deviation`` (decimal).

    ``whitened`` is null for components whose eigenvalue is zero to double precision.  ``deviation`` is the exact
    sum over dimensions of (n * x - sums)^2, null beyond 38 digits.  Columns of ``rows`` with these names are
    replaced.  Rows that repeat give equal rows; without a model there are no rows.
    """
    kept = [c for c in rows.columns if c.lower() not in ("whitened", "deviation") and c != vector]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*[F.col(f"`{c}`") for c in kept]).dtypes], "whitened array<double>", "deviation decimal(38,0)"])
    chosen = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(vector).alias("__vector"))
    if model is None:
        return chosen.limit(0).drop("__vector").selectExpr("*", "CAST(NULL AS array<double>) AS whitened", "CAST(NULL AS decimal(38,0)) AS deviation")
    used = min(components, model.length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, matrix = finite_vectors(batch.column(len(kept)), model.length)
            z, centred = _whitened(whole_numbers(matrix), model, used)
            most = max(abs(int(centred.min(initial=0))), abs(int(centred.max(initial=0))))
            exact = _wide(centred, most, model.length)
            deviation = (exact * exact).sum(axis=1).tolist()
            flat = pa.array(z.ravel(), pa.float64(), from_pandas=True)  # NaN: null
            lists = pa.ListArray.from_arrays(np.arange(0, len(z) * used + 1, used, dtype=np.int32), flat)
            decimals = pa.array([Decimal(int(d)) if d < 10**38 else None for d in deviation], pa.decimal128(38, 0))
            at = pa.array(places)
            yield pa.RecordBatch.from_arrays(
                [*[c.take(at) for c in batch.columns[: len(kept)]], lists, decimals], names=[*kept, "whitened", "deviation"]
            )

    return chosen.mapInArrow(run, schema)
