"""Embedding near-dedup: sign hashing by random hyperplanes in several tables, exact cosines, components.

Equal vectors are one class first. In each table a class falls into the bucket of its signs. Buckets are cut into
blocks of BLOCK classes and each pair of blocks is a unit of work, so one hot bucket spreads over many tasks. A unit
computes exact double cosines by matrix product and counts a pair only in the first table in which the two
meet, so counts are of different pairs although no pair is ever emitted: a unit returns each class's number
of linked vectors and the edges of a spanning forest of its links. Only numbers travel with the codes; a unit fetches its vectors, as
they are stored, and hashes again only those that it links, to see where they met first.

Null vectors, zero vectors and vectors with null or non-finite components link with nothing. So do vectors of
another length than the one they are compared with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, local_links, staged, table

BLOCK, PER_BUCKET, MARGIN = 512, 64, 1e-9


def plan_bits(n: int, per_bucket: int = PER_BUCKET) -> int:
    """Sign bits of each table: buckets of unrelated vectors hold about per_bucket at any table size."""
    return int(min(62, max(4, np.ceil(np.log2(max(n, 1) / per_bucket)))))


def plan_tables(bits: int, cosine: float, miss: float = 1e-4) -> int:
    """Tables so that a pair at the threshold is missed with probability of at most `miss`; a link is likelier found above it."""
    hit = (1 - np.arccos(cosine) / np.pi) ** bits
    return int(np.ceil(np.log(miss) / np.log1p(-hit)))


def planes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((count, dim))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine by sums that round once, of vectors scaled by their largest components."""
    a, b = (x.astype(np.float64) / np.abs(x.astype(np.float64)).max() for x in (a, b))
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def link_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, seed: int = 7) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of vectors. Keys are integers. Rows are vectors of their own whatever their keys: a row with a null key links
    like any other, with a component of null where no row of the component has a key; rows that share a key are counted and linked apart."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    kept = F.col(vector) if kind in ("float", "double") else F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), kept.alias("v"))
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0.0), F.lit(False))
    rows = rows.withColumn("digest", F.when(good, F.sha2(F.array_join(F.transform("v", lambda x: (x.cast("double") + F.lit(0.0)).cast("string")), ","), 256)))
    classes = staged(rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.min("v").alias("v")).withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    bits = plan_bits(n)
    tables = plan_tables(bits, cosine)

    def normal(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def codes_of(x: np.ndarray, count: int) -> np.ndarray:
        """The signs' code of each vector in the first `count` tables."""
        signs = (x @ planes(x.shape[1], tables * bits, seed)[: count * bits].T > 0).reshape(len(x), count, bits)
        return signs @ (np.int64(1) << np.arange(bits))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, col = b.column(0).to_numpy(), b.column(1)
            size = np.diff(col.offsets.to_numpy())
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                codes = codes_of(normal(col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)), tables)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), t, np.int32)), pa.array(codes[:, t])], names=["rep", "dim", "tab", "code"])

    # only buckets with company matter; their rows fetch the vector later, so this shuffle is of a few numbers
    spread = staged(classes.select("rep", "v").mapInArrow(hashed, "rep long, dim int, tab int, code long"), "vector-codes")
    sizes = spread.groupBy("dim", "tab", "code").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    met = spread.join(sizes, ["dim", "tab", "code"]).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("rep", "tab", "mine", F.concat_ws("/", "dim", "tab", "code", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("mine") == F.col("other")).alias("alone"))
    units = met.join(classes.select("rep", "copies", "v"), "rep")

    def compare(t: pa.Table) -> pa.Table:
        tab = t.column("tab")[0].as_py()
        ids, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        given = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        x = normal(given)
        side, alone = t.column("side").to_numpy(), t.column("alone")[0].as_py()
        left, right = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, ea, eb = np.zeros(len(ids), np.int64), [], []
        if len(left) and len(right):
            c = x[left] @ x[right].T
            a, b = np.nonzero(c >= cosine - MARGIN)
            near = np.flatnonzero(c[a, b] < cosine + MARGIN)
            a, b = left[a], right[b]
            keep = a != b
            # next to the threshold a product of matrices may round either way, so those pairs have exact sums
            keep[near] &= np.array([exact_cosine(given[i], given[j]) >= cosine for i, j in zip(a[near], b[near], strict=True)], bool)
            a, b = a[keep], b[keep]
            if tab and len(a):
                some, which = np.unique(np.concatenate([a, b]), return_inverse=True)
                codes = codes_of(x[some], tab)
                keep = ~(codes[which[: len(a)]] == codes[which[len(a) :]]).any(1)
                a, b = a[keep], b[keep]
            np.add.at(links, a, copies[b])
            if not alone:
                np.add.at(links, b, copies[a])
            if len(a):
                ea, eb = local_links(a, b)
        some = np.flatnonzero(links)
        to = np.full(len(ids), -1, np.int64)
        to[np.asarray(ea, np.int64)] = ids[np.asarray(eb, np.int64)]
        return pa.table({"rep": ids[some], "links": links[some], "other": pa.array(to[some], mask=to[some] < 0)})

    found = staged(units.groupBy("unit").applyInArrow(compare, "rep long, links long, other long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), "vector-components")
    # classes are known by numbers, a component by the smallest key in it
    least = joined.join(classes.select(F.col("rep").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    per_class = classes.select("digest", "rep", "first", "copies").join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(least, "component", "left")
    out = rows.select("id", "digest").join(per_class, "digest", "left")
    component = F.coalesce("least", "first", "id")
    return out.select(F.col("id").alias(key), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), m AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN m ON vec_id = m.a
"""
