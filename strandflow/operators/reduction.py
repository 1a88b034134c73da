"""Linear dimensionality reduction of a table of vectors: principal components by a randomised range finder.

The table is read once a power step; tasks send sums as wide as the vectors by `size` + EXTRA, which the driver orthogonalises. Rows are only touched in their partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTRA = 8  # directions beyond those asked for


@dataclass
class Components:
    mean: np.ndarray
    directions: np.ndarray  # vectors' width x size, in order of variance; the largest entry of each is positive
    variance: np.ndarray


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    col = b.column(0)
    if not len(col):
        return np.zeros((0, width))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != width * len(col) or not np.isfinite(flat).all():
        raise ValueError("vectors differ in length or hold null or non-finite components")
    return flat.reshape(len(col), width)


def _summed(rows: DataFrame, width: int, product) -> np.ndarray:
    """The sum over all rows of product(matrix), arrays of one shape; a partial sum a partition reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((product(_matrix(b, width)) for b in batches), 0)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    parts = [np.frombuffer(r[0]) for r in rows.mapInArrow(run, "x binary").collect()]
    return np.sum(parts, axis=0)


def fit(df: DataFrame, vector: str, size: int, power: int = 6, seed: int = 1) -> Components:
    """The first `size` principal components of the vectors that are not null. Each of `power` steps adds to the subspace what the table makes of the last directions added (a block
    Krylov space), so it sharpens with every step, and is exact where `power` + 1 times `size` + EXTRA reach the vectors' width."""
    rows = df.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
    first = rows.first()
    if first is None:
        raise ValueError("no vectors")
    width = len(first.v)
    n, *mean = _summed(rows, width, lambda x: np.concatenate([[len(x)], x.sum(0)]))
    mean = np.array(mean) / n
    k = min(width, size + EXTRA)
    q = last = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, k)))[0]
    for _ in range(power):
        if q.shape[1] == width:
            break
        now = last
        y = _summed(rows, width, lambda x: ((x - mean).T @ ((x - mean) @ now)).ravel()).reshape(width, -1)
        for _ in range(2):  # once more for what rounding leaves
            y = y - q @ (q.T @ y)
        last = np.linalg.qr(y)[0][:, : width - q.shape[1]]
        q = np.linalg.qr(np.hstack([q, last]))[0]
    small = _summed(rows, width, lambda x: (((x - mean) @ q).T @ ((x - mean) @ q)).ravel()).reshape(q.shape[1], -1)
    values, vectors = np.linalg.eigh(small)
    order = np.argsort(-values)[:size]
    directions = q @ vectors[:, order]
    directions *= np.sign(directions[np.abs(directions).argmax(0), np.arange(len(order))])
    return Components(mean, directions, values[order] / n)


def project(df: DataFrame, key: str, vector: str, c: Components) -> DataFrame:
    """(key, projection) of each row: its coordinates along the components; null where the vector is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False))
            x = _matrix(pa.RecordBatch.from_arrays([b.column(1).take(pa.array(good))], names=["v"]), len(c.mean))
            out: list = [None] * b.num_rows
            for k, v in zip(good.tolist(), ((x - c.mean) @ c.directions).tolist(), strict=True):
                out[k] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, "projection"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.transform(vector, lambda x: x.cast("double")).alias("_v")).mapInArrow(run, f"`{key}` {kind}, projection array<double>")
