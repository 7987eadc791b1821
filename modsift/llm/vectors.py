"""Vector columns as numpy matrices inside tasks, and exact sums of whole numbers across tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMB = 40  # bits


def common_length(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have (ties: the longer); 0 if no vector has an entry."""
    sizes = rows.where(F.size(F.col(vector)) > 0).groupBy(F.size(F.col(vector)).alias("length")).count()
    best = sizes.orderBy(F.desc("count"), F.desc("length")).first()
    return best["length"] if best else 0


def finite_vectors(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and matrix (float64) of the vectors with ``length`` entries, none of them null or non-finite."""
    right = pc.equal(pc.fill_null(pc.list_value_length(column), -1), length)
    places = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = column.filter(right).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
    matrix = flat.reshape(len(places), length)
    finite = np.isfinite(matrix).all(axis=1)
    return places[finite], matrix[finite]


def floored(matrix: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * entry) as int64, held between -most and most."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * matrix), -float(most), float(most)).astype(np.int64)


def limb_batch(numbers: list[int]) -> pa.RecordBatch:
    """Numbers of any size as rows (k, limb, v) with |v| < 2**LIMB: sums of v over many rows stay inside a long."""
    k, limb, v = [], [], []
    for i, number in enumerate(numbers):
        rest, sign, at = abs(int(number)), 1 if number >= 0 else -1, 0
        while rest:
            k.append(i)
            limb.append(at)
            v.append(sign * (rest & ((1 << LIMB) - 1)))
            rest, at = rest >> LIMB, at + 1
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(limb, pa.int32()), pa.array(v, pa.int64())], names=["k", "limb", "v"])


LIMB_COLUMNS = "k int, limb int, v long"


def summed_limbs(parts: DataFrame, size: int) -> list[int]:
    """The ``size`` numbers whose parts the rows of LIMB_COLUMNS are; few limbs a number reach the driver."""
    out = [0] * size
    for k, limb, v in parts.groupBy("k", "limb").agg(F.sum("v")).collect():
        out[k] += v << (LIMB * limb)
    return out
