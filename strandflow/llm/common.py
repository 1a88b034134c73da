"""Shared plumbing: the shared folder, written stages, word and hash kernels for Arrow batches.

Nothing here keeps state between calls.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_PATHS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a temporary one serves a local master (tests); a cluster raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="strandflow-")
        shared_dir.own = base
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/strandflow/{name}-{uuid.uuid4().hex}"
    _PATHS.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_paths() -> None:
    for spark, path in _PATHS:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone
            return


def discard(df: DataFrame) -> None:
    """Deletes the table behind a staged DataFrame, once nothing will read it again."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)
        _PATHS[:] = [x for x in _PATHS if x[1] != path]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- kernels over Arrow batches -----------------------------------------------------------------

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection, so it adds no collisions."""
    h = h ^ (h >> U64(30))
    h *= _M1
    h ^= h >> U64(27)
    h *= _M2
    h ^= h >> U64(31)
    return h


def _class_table(kind: str) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    t = np.ones(256, bool)
    t[0x20] = False
    t[0x09:0x0E] = False
    return t


_SPACE = _class_table("space")
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a run of rows: bytes, [start, end) of each word, its row, and each row's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # len rows + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; equal words have equal hashes whatever batch they are in.

        Lanes of eight bytes are mixed with their place before they are summed, so no rule of letters or of their order makes two words equal."""
        size = self.end - self.start
        raw = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(self.data) + 1,), "<u8", raw, strides=(1,))  # the eight bytes from each byte on
        total = size.astype(U64) * _GOLD
        for k in (0, 1):
            at = np.flatnonzero(size > 8 * k) if k else slice(None)
            total[at] += self._lane(lanes, self.start[at] + 8 * k, size[at] - 8 * k, np.full(1, k))
        long = np.flatnonzero(size > 16)
        if len(long):
            number = (size[long] - 9) // 8  # lanes after the second
            first = np.cumsum(number) - number
            k = np.arange(int(number.sum())) - np.repeat(first, number) + 2
            x = self._lane(lanes, np.repeat(self.start[long], number) + 8 * k, np.repeat(size[long], number) - 8 * k, k)
            total[long] += np.add.reduceat(x, first)
        return mix(total)

    @staticmethod
    def _lane(lanes: np.ndarray, at: np.ndarray, left: np.ndarray, number: np.ndarray) -> np.ndarray:
        x = lanes[at]
        x &= _LOW_BYTES[np.minimum(left, 8)]
        return mix(x + (number + 1).astype(U64) * _GOLD)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of each text; null texts have none. Words never span rows."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if lower:
        data = _LOWER[data]
    inside = _SPACE[data]
    n = len(data)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] |= inside[cut]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    return Words(data, start, end, row, first)


def slices(batch: pa.RecordBatch, column: str | int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `limit` bytes of text; a longer single row is a run."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_CACHE_WORDS = 2_000_000


class WordCache:
    """Ids of words, each different one encoded once a worker; a subclass has `kind` (of its ids) and encode_words(words) -> (ids of all, number of each).

    Words are known by a 64-bit hash of their bytes and length, in sorted arrays. The cache is emptied when it would pass
    _CACHE_WORDS words, which bounds its memory and changes no result."""

    kind: type = np.uint32

    def reset(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.offsets = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        if len(self.keys) + len(words) > _CACHE_WORDS:
            self.reset()
        flat, sizes = self.encode_words(words)
        at = np.searchsorted(self.keys, hashes)
        self.slots = np.insert(self.slots, at, np.arange(len(words), dtype=np.int32) + (len(self.offsets) - 1))
        self.keys = np.insert(self.keys, at, hashes)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, flat.astype(self.kind)])

    def known(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)

    def encode_split(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, bounds of each row's ids)."""
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(w.first), np.int64)
        uniq, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        new = ~self.known(uniq)
        if len(self.keys) + new.sum() > _CACHE_WORDS:
            self.reset()
            new[:] = True
        data = w.data.tobytes()
        self.learn(uniq[new], [data[s:e] for s, e in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
        slot = self.slots[np.searchsorted(self.keys, uniq)]
        begin, size = self.offsets[slot][inverse], (self.offsets[slot + 1] - self.offsets[slot])[inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        return self.ids[index].astype(np.uint32), total[w.first]


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Returns freed memory to the system: an idle worker, which lives on for later tasks, else holds its largest task's memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def lean(group: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of one group, which gives memory back after each call."""

    def run(t: pa.Table) -> pa.Table:
        try:
            return group(t)
        finally:
            give_back()

    return run


_STEP = U64(0xD1342543DE82EF95)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of each k consecutive word hashes, over row borders too (see `same_row`)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    g = h[:m].copy()
    for i in range(1, k):
        g *= _STEP
        g += h[i : i + m]
    return mix(g)


def same_row(row: np.ndarray, k: int) -> np.ndarray:
    m = len(row) - k + 1
    return row[k - 1 :] == row[:m] if m > 0 else np.zeros(0, bool)


def blob_array(parts: list) -> pa.Array:
    return pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in parts], pa.binary())


# --- packing of arrays: differences and byte planes, so that compression finds the zeros --------


def pack_arrays(*arrays: np.ndarray) -> bytes:
    out = [np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()]
    for a in arrays:
        out.append(np.ascontiguousarray(a.astype(U64).view(np.uint8).reshape(-1, 8).T).tobytes())
    return b"".join(out)


def unpack_arrays(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for s in sizes.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * s, at).reshape(8, s).T).view(U64).ravel())
        at += 8 * s
    return out


def differences(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=U64(0))


def runs(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


# --- connected components -----------------------------------------------------------------------


HOT_KEYS = 256


def join_hot(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined on `key` to values (key, ..., n), where n is the key's number of rows and `total` that of all rows.

    Keys with more than a share of 1 / HOT_KEYS of the rows number fewer than HOT_KEYS, whatever the table's size: they are broadcast,
    and their rows stay where they are. The other keys are shuffled."""
    from pyspark.sql import functions as F

    limit = max(total // HOT_KEYS, 1)
    hot = F.broadcast(values.where(F.col("n") > limit).drop("n"))
    cold = rows.join(F.broadcast(values.where(F.col("n") > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(values.where(F.col("n") <= limit).drop("n"), key))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node in edges (a, b).

    Alternating large-star and small-star rounds on distributed edge tables. Each round is written to the
    shared folder; only counters reach the driver. A hub's edges are spread by partial aggregation and `join_hot`.
    Raises if `max_rounds` do not suffice, never truncates."""
    from pyspark.sql import functions as F

    def tally(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = tally(e)
    for _ in range(max_rounds):
        # large star: a node's larger neighbours move to its smallest one
        both = e.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("less"), F.lit(1).alias("one")).union(e.select(F.col("u").alias("node"), F.col("v").alias("less"), F.lit(0).alias("one")))
        least = both.groupBy("node").agg(F.min("less").alias("m"), F.sum("one").alias("n")).where("n > 0").select(F.col("node").alias("v"), F.coalesce("m", "node").alias("m"), "n")
        large = staged(join_hot(e, least, "v", before[0]).select("u", F.col("m").alias("v")).distinct(), name)
        # small star: a node and its smaller neighbours move to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, "u", before[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        done, e = e, staged(small, name)
        discard(done)
        discard(large)
        now = tally(e)
        # star rounds change any forest but a star for each component, so unchanged edges are the fixed point
        if now == before:
            roots = e.select("v").distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
        before = now
    raise RuntimeError("components did not converge")


def local_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest with the same components as the edges (a, b): each node to its smallest node."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]
