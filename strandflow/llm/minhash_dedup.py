"""MinHash near-dedup by min-max hashing, exact confirmation on full shingle sets, and connected components.

Each permutation keeps its minimum and its maximum, so PERMUTATIONS hash evaluations of a shingle give twice as many
signature values; BAND values in a row are a band. Documents with equal sets are one class first (a 128-bit sum over the
set), so a group of copies is one row from there on.

Links are sought in two rounds that never emit all pairs of a bucket. Round 1 confirms each class against the smallest class it
shares a bucket with, and joins what is confirmed. Then only buckets that still hold several components matter: they are cut
into blocks of about BLOCK classes and BLOCK_SHINGLES shingles, pairs of blocks are units of work, and a unit counts the exact intersections of the full sets of its classes by
a matrix product over the shingles that two or more of them have. It returns a spanning forest of the links it finds between
different components; pairs inside a component need no more links.
A pair at the threshold shares no band with probability of about (1 - 0.75^4)^30 = 1e-5, less above it.
In small sets minimum and maximum of one permutation depend on each other: both agree with m (m - 1) / (n (n - 1)) for m shared of n
shingles, so for 3 of 4 a band agrees with 1/4 and the pair is missed with 0.75^30 = 1.8e-4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, components, discard, local_links, mix, ngrams, same_row, slices, split_words, staged, table

WORDS, PERMUTATIONS, BAND, PERCENT, BLOCK, BLOCK_SHINGLES, COLUMNS, SEED = 5, 60, 4, 75, 512, 2_000_000, 2048, 5
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, PERMUTATIONS, np.uint64) * U64(2) + U64(1)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(different shingle hashes of each text in order, bounds of each text). Texts with fewer words have one shingle, their
    whole sequence; texts without words have none."""
    w = split_words(texts, lower=True)
    h = w.hashes()
    inside = same_row(w.row, words)
    grams, rows = [ngrams(h, words)[inside]], [w.row[: len(inside)][inside]]
    for k in range(1, words):
        short = np.flatnonzero(w.counts == k)
        if len(short):
            grams.append(mix(ngrams(h, k)[w.first[short]] + U64(k)))
            rows.append(short.astype(np.int32))
    g, r = np.concatenate(grams), np.concatenate(rows)
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[new], r[new]
    return g, np.searchsorted(r, np.arange(len(texts) + 1))


def signatures(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation for each row with shingles, side by side."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), 2 * PERMUTATIONS), U64)
    at = 0
    while at < len(full):  # runs of rows that fit a processor's cache
        to = max(at + 1, int(np.searchsorted(bounds[full], bounds[full[at]] + (1 << 15))))
        run = full[at:to]
        low = bounds[run[0]]
        x, starts = g[low : bounds[run[-1] + 1]], bounds[run] - low
        y = np.empty_like(x)
        for p, a in enumerate(_FACTORS):
            np.multiply(x, a, out=y)
            out[run, 2 * p] = np.minimum.reduceat(y, starts)
            out[run, 2 * p + 1] = np.maximum.reduceat(y, starts)
        at = to
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row; keys of different bands differ."""
    n = signature.shape[1] // BAND
    keys = np.zeros((len(signature), n), U64)
    for k in range(BAND):
        keys = mix(keys * U64(0xD1342543DE82EF95) + signature[:, k : n * BAND : BAND])
    return mix(keys + np.arange(n, dtype=U64))


def sketch(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, keys) of each document: set size, 128-bit sum over the set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                g, bounds = shingle_sets(b.column(1))
                n = np.diff(bounds)
                k = bands(signatures(g, bounds))
                k[n == 0] = 0
                sums = []
                for c in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(g ^ U64(c)))])
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32)), pa.array(k.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *map(pa.array, sums), keys], names=["doc_id", "n_shingles", "f1", "f2", "keys"])

    return documents.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>")


def full_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, shingles): each document's sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                g, bounds = shingle_sets(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])

    return documents.mapInArrow(run, "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = t.column(2), t.column(3)
            ok = np.zeros(t.num_rows, bool)
            for i in range(t.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), U64), np.frombuffer(y[i].as_buffer(), U64)
                if len(p) > len(q):
                    p, q = q, p
                if 100 * len(p) < percent * len(q):
                    continue
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                ok[i] = 100 * both >= percent * (len(p) + len(q) - both)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(mask), t.column(1).filter(mask)], names=["a", "b"])

    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked(sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a of left and b of right, in different components whose sets have 100 * intersection >= percent * union."""
    n = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    both = np.zeros((len(left), len(right)), np.float32)  # counts under 2^24 are exact
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        both += dense[left] @ dense[right].T
    ok = (100 * both.astype(np.float64) >= percent * (n[left][:, None] + n[right][None, :] - both.astype(np.float64))) & (component[left][:, None] != component[right][None, :])
    a, b = np.nonzero(ok)
    return left[a], right[b]


def bridges(members: DataFrame, joined: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between different components, enough to join them. members: (key, rep, n_shingles); joined: (node, component)."""
    m = members.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_keys = m.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).where("low < high")
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.least("n", F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES)))).cast("int")
    m = m.join(open_keys.select("key", blocks.alias("blocks")), "key").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("rep", "component", F.concat_ws("/", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), (F.col("mine") > F.col("other")).alias("right"), (F.col("mine") == F.col("other")).alias("alone"))
    units = m.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")

    def compare(t: pa.Table) -> pa.Table:
        ids, component, right = (t.column(c).to_numpy() for c in ("rep", "component", "right"))
        left, other = (np.arange(len(ids)),) * 2 if t.column("alone")[0].as_py() else (np.flatnonzero(~right), np.flatnonzero(right))
        a = b = np.zeros(0, np.int64)
        if len(left) and len(other) and component.min() < component.max():
            a, b = linked([np.frombuffer(x.as_buffer(), U64) for c in t.column("shingles").chunks for x in c], component, left, other)
            if len(a):
                a, b = local_links(a, b)
        return pa.table({"a": ids[a], "b": ids[b]})

    return units.groupBy("unit").applyInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of documents.

    Documents without words link with nothing, not even with one another. Ids are integers; rows with the same id are one
    node. A row with a null id links with nothing and no row with it: its component_id is null and it is kept. Columns other than the
    two are not read; an empty table gives an empty result."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = staged(sketch(docs), "sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = staged(full.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "keys")).alias("first")).select("f1", "f2", "n_shingles", F.col("first.doc_id").alias("rep"), "first.keys"), "sketch-classes")
    keyed = classes.select("rep", "n_shingles", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "low")
    members = staged(keyed.join(shared, "key"), "bucket-members")
    stars = staged(members.where("rep <> low").groupBy("rep").agg(F.min("low").alias("a")).select("a", F.col("rep").alias("b")), "stars")
    sets = staged(full_sets(docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")), "shingle-sets")
    links = staged(confirmed(stars, sets), "links")
    joined = components(links, "components")
    more = staged(bridges(members.select("key", "rep", "n_shingles"), joined, sets), "bridges")
    for done in (members, sets, stars):
        discard(done)
    joined = components(links.union(more), "components")
    named = classes.select("f1", "f2", "n_shingles", "rep").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = sketches.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select(F.col("doc_id").alias(doc_id), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= {PERCENT} * (p.n + q.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON d.doc_id = m.a
"""
