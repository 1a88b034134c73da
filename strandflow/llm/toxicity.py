"""Toxicity: logistic regression on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the different hashed character n-grams of its lower-cased whole text (lengths LENGTHS, BUCKETS
buckets). On at most SAMPLE labelled documents, document counts per bucket and class give log-count ratios. A regularised logistic
regression is fitted on presence times ratio of the FEATURES buckets whose class shares differ most significantly, each with a weight of its own,
and on one more feature for all other buckets that SUPPORT labelled documents have: the sum of their ratios over the text's positions by
the root of the number of positions. So every n-gram with support counts. A model of this kind is too sure of the documents that it was fitted on
and too timid elsewhere, so its log odds are rescaled: for FOLDS parts of the labelled documents (equal texts in one), features, ratios and weights are learnt without the part and judge it, and a line through
these log odds is fitted to the labels. Texts that are equal score equal; null and empty texts have no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged, table
from .labelled import remainder, sample_labels

LENGTHS, BUCKETS, FEATURES, SUPPORT, SAMPLE, SLICES = (4, 5, 6), 1 << 20, 4096, 20, 12_000, 64
THRESHOLD, RIDGE, ROUNDS, FOLDS = 0.5, 1e-3, 300, 2
RANKED = np.dtype([("bucket", "<i4"), ("ratio", "<f8"), ("z", "<f8"), ("n", "<i8")])
BLOCK = 1 << 18  # features that a gradient step looks at together
_A = np.uint32(0x01000193)


def gram_buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length, (bucket at each position, bounds of each text in positions). Texts are lower-cased, with a
    space before and after; positions near a text's end run into the next text and are cut by `rows_of`."""
    lower = [" " + (x or "").lower() + " " for x in texts.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lower])])
    c = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = (c + np.uint32(1)) * np.uint32(0x9E3779B1)
    c ^= c >> np.uint32(15)
    g = c
    for k in range(1, max(LENGTHS)):
        g = g[:-1] * _A + c[k:]
        if k + 1 in LENGTHS and len(g):
            h = (g ^ (g >> np.uint32(16))) * np.uint32(0x85EBCA6B) + np.uint32(k)
            yield h >> np.uint32(32 - BUCKETS.bit_length() + 1), bounds
        elif k + 1 in LENGTHS:
            yield np.zeros(0, np.uint32), bounds


def rows_of(positions: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each position, whether the n-gram there ends inside the row)."""
    row = np.searchsorted(bounds, positions, side="right") - 1
    return row, positions + length <= bounds[row + 1]


def present(texts: pa.Array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different (row, feature) of texts, in order; number: the feature of each bucket, or -1."""
    rows, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length, (bucket, bounds) in zip(LENGTHS, gram_buckets(texts), strict=True):
        f = number[bucket]
        at = np.flatnonzero(f >= 0)
        row, inside = rows_of(at, bounds, length)
        rows.append(row[inside])
        features.append(f[at[inside]].astype(np.int64))
    width = int(number.max()) + 1 if len(number) else 1
    both = np.unique(np.concatenate(rows) * max(width, 1) + np.concatenate(features))
    return both // max(width, 1), both % max(width, 1)


def rest_sums(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """The sum of ratio over the n-grams at all positions of each text, by the root of the number of positions."""
    out = np.zeros(len(texts))
    for length, (bucket, bounds) in zip(LENGTHS, gram_buckets(texts), strict=True):
        total = np.concatenate([[0.0], np.cumsum(ratio[bucket], dtype=np.float64)])
        ends = np.maximum(bounds[1:] - length + 1, bounds[:-1])
        out += total[np.minimum(ends, len(bucket))] - total[np.minimum(bounds[:-1], len(bucket))]
    return out / np.sqrt(np.maximum(np.diff(bounds), 1))


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    rest: np.ndarray  # log-count ratio of each other bucket
    slope: float
    scale: float = 1.0  # what the log odds are rescaled by
    shift: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.buckets):
            number = np.full(BUCKETS, -1, np.int16)
            number[self.buckets] = np.arange(len(self.buckets))
            row, feature = present(texts, number)
            z += np.bincount(row, self.weights[feature], len(texts))
        if self.slope:
            z += self.slope * rest_sums(texts, self.rest)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -500, 500)))


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS, dense: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """Weights of presence (ratio included), bias and the weight of the dense feature, by accelerated gradient steps on the regularised mean log loss."""
    sizes = np.array([len(r) for r in rows])
    index = np.concatenate([np.zeros(0, np.uint16), *rows]).astype(np.uint16 if len(ratio) <= 1 << 16 else np.int64, copy=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    # a step goes over the rows block by block, so what it holds beside the features stays small
    edges = np.unique(np.concatenate([np.searchsorted(ends[:-1], np.arange(0, ends[-1], BLOCK)), [0, len(rows)]])).tolist()
    blocks = list(zip(edges, edges[1:]))

    def by_row(values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), values[index[ends[a] : ends[b]]], b - a) for a, b in blocks])

    def by_feature(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ratio))
        for a, b in blocks:
            out += np.bincount(index[ends[a] : ends[b]], np.repeat(values[a:b], sizes[a:b]), len(ratio))
        return out

    dense = np.zeros(len(rows)) if dense is None else dense
    base = min(max(y.mean(), 1e-4), 1 - 1e-4)
    k = len(ratio)
    w = np.zeros(k + 2)  # then the dense feature's and the bias
    w[-1] = np.log(base / (1 - base))
    shrink = np.append(np.full(k + 1, ridge), 0.0)
    bound = (by_row(ratio * ratio) + dense * dense).mean() + 1  # of the mean loss' curvature, a quarter at most
    step, m = 2.0 / bound, w.copy()
    for t in range(rounds):
        z = by_row(ratio * m[:k]) + m[k] * dense + m[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(rows)
        new = m - step * (np.concatenate([ratio * by_feature(g), [g @ dense, g.sum()]]) + shrink * m)
        m = new + t / (t + 3) * (new - w)
        w = new
    return w[:k] * ratio, float(w[-1]), float(w[k])


def rescaling(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that the log odds a * z + b fit the labels best, by Newton's steps; a is positive. With one class nothing changes."""
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    x = np.stack([z, np.ones(len(z))], 1)
    # labels a little inside of 0 and 1, so that separable ones have an answer
    t = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fitted on about `sample` labelled documents at most. With no labelled row the score is 0.5, with one class its share."""
    spark = documents.sparkSession
    chosen = sample_labels(labels, label, F.lit(True) if usable is None else usable, sample)
    docs = staged(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-sample")
    size = np.zeros((FOLDS, 2), np.int64)
    for r in docs.groupBy("fold", (F.col("y") > 0.5).cast("int").alias("side")).agg(F.count("*").alias("n")).collect():
        size[r["fold"], r["side"]] = r["n"]
    neg, pos = size.sum(0).tolist()
    if not pos or not neg:
        share = (pos + 1) / (pos + neg + 2)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))), np.zeros(0), 0.0)
    wide = BUCKETS // SLICES
    # each part's complement, where that has both classes, then all
    without = [k for k in range(FOLDS) if (size.sum(0) - size[k]).min() > 0]
    without = without if len(without) == FOLDS else []
    chosen_by = [np.arange(FOLDS) != k for k in without] + [np.ones(FOLDS, bool)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, all_buckets = np.zeros((FOLDS, 2, BUCKETS), np.int32), np.arange(BUCKETS, dtype=np.int32)
        some = False
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                y, fold = b.column(1).to_numpy(), b.column(2).to_numpy()
                row, bucket = present(b.column(0), all_buckets)
                for side in (0, 1):
                    for k in range(FOLDS):
                        total[k, side] += np.bincount(bucket[((y[row] > 0.5) == side) & (fold[row] == k)], minlength=BUCKETS).astype(np.int32)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[:, :, k * wide : (k + 1) * wide].tobytes() for k in range(SLICES)], pa.binary())], names=["part", "counts"])

    def rank(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        counts = sum(np.frombuffer(x.as_py(), np.int32).reshape(FOLDS, 2, wide).astype(np.int64) for x in t.column("counts"))
        found = []
        for c, own in enumerate(chosen_by):
            n, p = counts[own].sum(0)
            neg, pos = size[own].sum(0)
            ratio = np.log((p + 1) / (pos + 2)) - np.log((n + 1) / (neg + 2))
            mean = (p + n + 1) / (pos + neg + 2)
            z = np.abs((p + 0.5) / (pos + 1) - (n + 0.5) / (neg + 1)) / np.sqrt(mean * (1 - np.minimum(mean, 0.999)) * (1 / pos + 1 / neg))
            z[p + n < 2] = 0
            top = np.argsort(-z, kind="stable")[:FEATURES]
            some = np.union1d(top[z[top] > 0], np.flatnonzero(p + n >= SUPPORT))
            packed = np.zeros(len(some), RANKED)
            packed["bucket"], packed["ratio"], packed["z"], packed["n"] = some + part * wide, ratio[some], z[some], (p + n)[some]
            found.append(packed.tobytes())
        return pa.table({"choice": pa.array(range(len(found)), pa.int32()), "packed": pa.array(found, pa.binary())})

    every = docs.coalesce(16).mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(rank, "choice int, packed binary").collect()  # SLICES cells a choice, of BUCKETS numbers in all at most; a row a bucket would fill the driver with objects
    chosen_features = []
    for c in range(len(chosen_by)):
        ranked = np.concatenate([np.frombuffer(r["packed"], RANKED) for r in every if r["choice"] == c])
        ranked = ranked[np.lexsort((ranked["bucket"], -ranked["z"]))]
        best = ranked[:FEATURES]
        best = best[best["z"] > 0]
        buckets, ratio = best["bucket"].copy(), best["ratio"].copy()
        rest = np.zeros(BUCKETS, np.float32)
        known = ranked[ranked["n"] >= SUPPORT]
        rest[known["bucket"]] = known["ratio"]
        rest[buckets] = 0
        number = np.full(BUCKETS, -1, np.int16)
        number[buckets] = np.arange(len(buckets))
        chosen_features.append((buckets, ratio, rest, number))

    del every

    def featurise(rest: np.ndarray, number: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, "text", 1 << 20):
                    row, feature = present(b.column(0), number)
                    parts = np.split(feature.astype(np.uint16), np.searchsorted(row, np.arange(1, b.num_rows)))
                    yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(rest_sums(b.column(0), rest))], names=["fold", "y", "features", "rest"])

        return run

    def fitted(c: int, left_out: int) -> tuple[tuple, np.ndarray, np.ndarray]:
        """The weights of a choice, fitted without a part, and that part's log odds and labels."""
        rows = docs.mapInArrow(featurise(*chosen_features[c][2:]), "fold int, y double, features binary, rest double").collect()  # at most about `sample` rows of at most FEATURES numbers
        order = sorted(rows, key=lambda r: (bytes(r["features"]), r["rest"], r["y"]))
        del rows
        inside = np.array([r["fold"] != left_out for r in order])
        features = [np.frombuffer(r["features"], np.uint16) for r in order]
        y, dense = np.array([float(r["y"] > 0.5) for r in order]), np.array([r["rest"] for r in order])
        w, bias, slope = fit_logistic([f for f, own in zip(features, inside, strict=True) if own], y[inside], chosen_features[c][1], dense=dense[inside])
        z = np.array([w[f].sum() for f, own in zip(features, inside, strict=True) if not own]) + slope * dense[~inside] + bias
        return (w, bias, slope), z, y[~inside]

    apart = [fitted(c, k)[1:] for c, k in enumerate(without)]
    a, b = rescaling(*(np.concatenate(x) for x in zip(*apart, strict=True))) if apart else (1.0, 0.0)
    (weights, bias, slope), *_ = fitted(len(without), -1)
    buckets, _, rest, _ = chosen_features[-1]
    return Model(buckets, weights, bias, rest, slope, a, b)


def score(documents: DataFrame, model: Model, also: tuple[str, ...] = ()) -> DataFrame:
    """(also..., score) of each row of documents; null and empty texts have the score of no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.scores(b.column(0)))], names=[*b.schema.names[1:], "score"])

    from pyspark.sql.types import DoubleType, StructType

    given = documents.select("text", *also)
    return given.mapInArrow(run, StructType(given.schema.fields[1:]).add("score", DoubleType()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    model = train(docs, labels, "toxic", remainder(F.col("doc_id"), 5) != 0)
    return score(docs, model, ("doc_id", "held_out")).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
