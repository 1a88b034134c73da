"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics come from each whole text by array code. At most SAMPLE labelled rows fit the model: FIT of 5 hashed fifths give means and
scales, and the normal equations, summed over partitions, of a ridge regression on cosine features that approximate a
Gaussian kernel; the remaining fifths calibrate its output by pool-adjacent-violators. Calibrated scores are
interpolated between the blocks' means, so they keep the order of the raw scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, split_words, staged, table
from .labelled import remainder, sample_labels

SAMPLE, RANDOM_FEATURES, RIDGE, FIT, THRESHOLD, SEED, PARTS = 40_000, 256, 1e-3, 4, 0.7, 11, 16
_FLAGS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "odd": [ord(c) for c in "!#$%&*"], "bar": [ord("|")], "stop": [ord(c) for c in ".,;:?"], "line": [10], "high": range(128, 256)}
STATISTICS = ("log_bytes", "log_words", "word_length", *(f"share_{k}" for k in _FLAGS), "different_words", "repeated_words", "odd_words", "upper_words", "short_words", "long_words", "line_length")


def statistics(texts: pa.Array) -> np.ndarray:
    """Rows of STATISTICS of texts; null and empty texts have zeros. All shares are of the whole text."""
    w = split_words(texts)
    rows = len(texts)
    sizes = np.zeros(rows + 1, np.int64)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    np.cumsum(lengths, out=sizes[1:])
    n, words = np.maximum(lengths, 1).astype(float), np.maximum(w.counts, 1).astype(float)
    out = [np.log1p(lengths), np.log1p(w.counts), np.bincount(w.row, w.end - w.start, rows) / words]
    kind = np.zeros(256, np.uint8)
    for k, values in enumerate(_FLAGS.values()):
        kind[list(values)] = k + 1
    kinds = kind[w.data]
    running = {}
    for k, name in enumerate(_FLAGS, 1):
        c = np.zeros(len(kinds) + 1, np.int32)
        np.cumsum(kinds == k, out=c[1:], dtype=np.int32)
        running[name] = c
        out.append((c[sizes[1:]] - c[sizes[:-1]]) / n)
    h = w.hashes()
    order = np.lexsort((h, w.row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.row[1:] != w.row[:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    inside = lambda name: running[name][w.end] - running[name][w.start]
    size = w.end - w.start
    for flag in (again, inside("odd") > 0, (inside("upper") > 1) & (inside("lower") == 0), size <= 2, size >= 12):
        out.append(np.bincount(w.row, flag, rows) / words)
    out.insert(-5, np.bincount(w.row, new, rows) / words)
    lines = running["line"]
    out.append(np.log1p(lengths / (lines[sizes[1:]] - lines[sizes[:-1]] + 1)))
    return np.column_stack(out).astype(np.float64)


def matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), len(STATISTICS)).astype(np.float64)


def pool(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (mean x, mean y) of the blocks of the isotonic fit of y on x. Rows with equal x are one point from the start."""
    at, which, n = np.unique(x, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []
    for a, b, w in zip(at.tolist(), np.bincount(which, y, len(at)).tolist(), n.tolist(), strict=True):
        blocks.append([b, float(w), a * w])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    planes: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.planes + self.phase), z, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """documents: doc_id and text, of which only sampled labelled rows are described. With no labelled row every score is 0.5;
    with one class the calibration gives its share. Repeated rows and repeated labels count as often as they stand."""
    chosen = sample_labels(labels, label, F.lit(True) if usable is None else usable, sample)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                x = statistics(b.column(0)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([r.tobytes() for r in x], pa.binary())], names=["fifth", "y", "stats"])

    fifth = (remainder(F.col("doc_id"), 1 << 31) % 5).alias("fifth")
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", fifth, "y")
    rows = staged(found.mapInArrow(describe, "fifth int, y double, stats binary"), "quality-sample").coalesce(PARTS)
    dim = len(STATISTICS)
    rng = np.random.default_rng(SEED)
    m = Model(np.zeros(dim), np.ones(dim), rng.standard_normal((dim, RANDOM_FEATURES)) / np.sqrt(dim), rng.uniform(0, 2 * np.pi, RANDOM_FEATURES), np.zeros(RANDOM_FEATURES + dim + 1), np.zeros(1), np.array([0.5]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, dim))
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                total += [np.full(dim, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    first = sum((np.frombuffer(r[0]).reshape(3, dim) for r in rows.where(F.col("fifth") < FIT).select("stats").mapInArrow(sums, "sums binary").collect()), np.zeros((3, dim)))
    n = max(first[0, 0], 1)
    m.mean = first[1] / n
    m.scale = np.maximum(np.sqrt(np.maximum(first[2] / n - m.mean**2, 0)), 1e-6)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                z = m.features(matrix(b.column(0)))
                total = total + np.column_stack([z.T @ z, z.T @ b.column(1).to_numpy()])
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    size = len(m.weights)
    both = [np.frombuffer(r[0]).reshape(size, size + 1) for r in rows.where(F.col("fifth") < FIT).select("stats", "y").mapInArrow(normal, "sums binary").collect()]  # at most PARTS rows
    if both:
        total = sum(both)
        m.weights = np.linalg.solve(total[:, :size] + RIDGE * n * np.eye(size), total[:, size])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(m.raw(matrix(b.column(0)))), b.column(1)], names=["raw", "y"])

    rest = rows.where(F.col("fifth") >= FIT).select("stats", "y").mapInArrow(raw, "raw double, y double").toPandas()  # a fifth of the sample
    if len(rest):
        m.at, m.value = pool(rest["raw"].to_numpy(), rest["y"].to_numpy())
    return m


def score(documents: DataFrame, model: Model, also: tuple[str, ...], name: str = "score") -> DataFrame:
    """(also..., name) of each row of documents, scored by its whole text; equal texts have equal scores. The text moves to Python once,
    also where it is kept. `name` must not be one of also; other names are free."""
    others = [c for c in also if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 0, 1 << 20):
                x = statistics(b.column(0)).astype(np.float32).astype(np.float64)
                kept = [b.column(0) if c == "text" else b.column(1 + others.index(c)) for c in also]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model.scores(x))], names=[*also, name])

    from pyspark.sql.types import DoubleType, StructType

    given = documents.select(F.col("text").alias("c"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(others)))
    return given.mapInArrow(run, StructType([documents.schema[c] for c in also]).add(name, DoubleType()))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    return train(documents, labels, "quality", remainder(F.col("doc_id"), 4) != 2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
