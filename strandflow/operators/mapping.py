"""Mapping of short sequences to a genome by sampled seeds, with exact checks and a verdict on uniqueness over both strands.

Seeds are runs of `k` bases whose hash falls into one of `sample` classes, so reads and genome keep the same ones without being compared. Genome seeds are cut from tiles; only
those that some read has are kept. Reads and genome meet by seed, candidate places are checked by a banded edit distance against the tiles, so no contig is ever one string.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from strandflow.functions import seq, stages

from . import intervals

WIDTH = 256
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
SLICE = 1024  # texts whose runs are hashed at once
STRETCH = 1 << 18  # symbols of tiles that are hashed at once
PROBES, MOST_BITS = 4, 30
CELLS, BLOCKS = 18, 16  # seeds are counted in 2^CELLS cells, which are added up in so many blocks


def _seeds(text: Column, k: int, sample: int) -> Column:
    """(at, h) of each sampled run of `k` bases; runs with other symbols than A, C, G, T are left out."""
    last = F.length(text) - k
    all_ = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("at"), F.substring(text, i + 1, F.lit(k)).alias("s")))
    good = F.filter(all_, lambda x: (F.length(x["s"]) == k) & ~x["s"].rlike("[^ACGT]"))
    hashed = F.transform(good, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["s"]).alias("h")))
    return F.filter(hashed, lambda x: F.pmod(x["h"], F.lit(sample)) == 0)


def genome_seeds(tiles: DataFrame, k: int, sample: int, width: int = WIDTH) -> DataFrame:
    """(chrom, pos, h): seeds of a genome in tiles; those over a tile's end are read with the head of the next one."""
    nxt = tiles.select("chrom", (F.col("tile_idx") - 1).alias("tile_idx"), F.substring("seq", 1, k - 1).alias("_more"))
    whole = tiles.join(nxt, ["chrom", "tile_idx"], "left").select("chrom", "tile_idx", F.upper(F.concat("seq", F.coalesce("_more", F.lit("")))).alias("s"))
    return whole.select("chrom", "tile_idx", F.explode(_seeds(F.col("s"), k, sample)).alias("x")).select("chrom", (F.col("tile_idx") * width + F.col("x.at")).alias("pos"), F.col("x.h").alias("h"))


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ROLL and of its inverse modulo 2^64."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]).cumprod() for x in (ROLL, np.uint64(pow(int(ROLL), -1, 1 << 64))))


class _Rolled:
    """Hashes of windows of an array of symbols, of any place and length at one step each: sums of the symbols times powers of ROLL's inverse, from the window's start."""

    def __init__(self, x: np.ndarray) -> None:
        self.up, down = _powers(1 << len(x).bit_length())
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x.astype(np.uint64) * down[: len(x)])])

    def at(self, i: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[i + size] - self.sums[i]) * self.up[i]

    def all(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return (self.sums[size:] - self.sums[:n]) * self.up[:n]


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols in one array, by bytes where all are ASCII and else by code points; the texts' lengths."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = b"".join(x.as_buffer() for x in texts)
    return np.frombuffer(raw, np.uint8) if raw.isascii() else np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), size


_CODE = np.full(256, 255, np.uint8)
_CODE[list(b"ACGT")] = range(4)


def _seed_hashes(x: np.ndarray, k: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, h): the sampled windows of `k` symbols without others than A, C, G, T."""
    code = _CODE[np.minimum(x, 255)]
    if len(x) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bad = np.concatenate([[0], np.cumsum(code == 255, dtype=np.int32)])
    i = np.flatnonzero(bad[k:] == bad[:-k])
    h = _Rolled(code).all(k)[i] * np.uint64(pow(int(ROLL), k - 1, 1 << 64))
    if sample > 1:
        keep = (h >> np.uint64(20)) % np.uint64(sample) == 0
        i, h = i[keep], h[keep]
    return i, h


def _text_seeds(texts: pa.Array, k: int, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, h) of the seeds within each text."""
    x, size = _symbols(texts)
    i, h = _seed_hashes(x, k, sample)
    ends = np.cumsum(size)
    row = np.searchsorted(ends, i, "right")
    keep = i + k <= ends[row]
    i, h, row = i[keep], h[keep], row[keep]
    return row, i - (ends - size)[row], h


def _cells(h: np.ndarray) -> np.ndarray:
    return ((h * MIX) >> np.uint64(64 - CELLS)).astype(np.int64)


def _runs(df: DataFrame, k: int, sample: int, cells: np.ndarray | None = None) -> DataFrame:
    """(key, h): the runs of `k` bases of each (key, s) as `_seeds` takes them, hashed in Arrow batches; the hash is another one. With `cells` only runs that fall into these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                row, _, h = _text_seeds(b.column(1), k, sample)
                if cells is not None:
                    keep = np.isin(_cells(h), cells)
                    row, h = row[keep], h[keep]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], names=["key", "h"])

    return df.select("key", "s").mapInArrow(run, StructType([df.schema["key"], StructField("h", LongType())]))


def _mixed(h: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    h = h ^ np.atleast_1d(np.asarray(tag, np.uint64)) * ROLL
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def _spots(h: np.ndarray, tag: np.ndarray | int, log: int) -> np.ndarray:
    """The places of each hash with a tag among 2^log bits."""
    h = _mixed(h, tag)
    return (np.concatenate([h * p for p in _powers(PROBES)[0]]) >> np.uint64(64 - log)).view(np.int64)


def _known(bits: np.ndarray, h: np.ndarray, tag: int) -> np.ndarray:
    """Which of the hashes have all their places set."""
    h, down = _mixed(h, tag), np.uint64(61 - (len(bits) - 1).bit_length())

    def set_(h: np.ndarray) -> np.ndarray:
        spot = h >> down
        return np.flatnonzero((bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1)

    i = set_(h)
    for p in _powers(PROBES)[0][1:]:
        i = i[set_(h[i] * p)]
    return i


def _bitmap(spots: DataFrame, log: int) -> Broadcast:
    """2^log bits, of which those of (spot) are set, for all workers."""

    def packed(t: pa.Table) -> pa.Table:
        of = t.column("spot").to_numpy()
        bits = np.zeros(1 << 20, np.uint8)
        bits[of & (len(bits) - 1)] = 1
        return pa.table({"block": pa.array([of[0] >> 20], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = spots.select("spot", F.shiftright("spot", 20).alias("block")).groupBy("block").applyInArrow(packed, "block long, bits binary")
    whole = np.zeros(1 << log - 3, np.uint8)
    for r in rows.collect():
        whole[r["block"] << 17 : r["block"] + 1 << 17] = np.frombuffer(r["bits"], np.uint8)
    return spots.sparkSession.sparkContext.broadcast(whole)


def _log(entries: int) -> int:
    """For 64 to 128 bits an entry; beyond the most, more windows are looked at twice."""
    return min(MOST_BITS, max(20, (64 * entries).bit_length()))


class _Stretch(NamedTuple):
    """Tiles in a row and their symbols x; by tile: where it starts in x, where its run of consecutive tiles stops, and up to where windows that start in it are known."""

    tiles: pa.RecordBatch
    x: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    seen: np.ndarray

    def tile(self, i: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, i, "right") - 1

    def new(self, i: np.ndarray, t: np.ndarray, size: int) -> np.ndarray:
        return (i + size <= self.stop[t]) & (i + size > self.seen[t])


def _swept(tiles: DataFrame, contigs: DataFrame | None, width: int, reach: int, visit: Callable[[Iterator[_Stretch]], Iterator[pa.RecordBatch]], schema: StructType, name: str) -> DataFrame:
    """What `visit` yields over stretches of tiles, in which each window of up to `reach` symbols is new once.

    Tiles lie in a partition as they were cut, so windows over their bounds are seen there, the last tiles of a batch going before the next one. Only where consecutive tiles are torn apart, those beside the
    tear are dealt out by their places and looked at again. Given contigs are cut into tiles where they are visited. `visit` may yield more after its last stretch."""
    more = max(1, -(-(reach - 1) // width))  # tiles that a window enters after its first one
    step, block = max(STRETCH // width, 4 * more, 1), max(1 << 10, 4 * more)
    columns = ["chrom", "tile_idx", "seq", "seen"]
    own, whole = [f.name for f in schema.fields], contigs is not None

    def stretches(batches: Iterator[pa.RecordBatch], torn: list[pa.RecordBatch]) -> Iterator[_Stretch]:
        last = head = None  # the last tiles of the run that is not over, and its first ones if it does not start a contig

        def over() -> None:
            rows = [] if head is None else [head]
            ends = (last.column(1)[-1].as_py() + 1) * width
            if pc.utf8_length(last.column(2)[-1]).as_py() == width:  # more may follow elsewhere
                known = -1 if head is None else head.column(1)[-1].as_py()
                rows.append(last.filter(pc.greater(last.column(1), known)))
            torn.extend(pa.RecordBatch.from_arrays([*r.columns[:3], pa.array(np.full(r.num_rows, ends))], names=columns) for r in rows if r.num_rows)

        for given in batches:
            for fresh in (given.slice(i, step) for i in range(0, given.num_rows, step)):
                b = fresh if last is None else pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(last.columns, fresh.columns, strict=True)], names=columns)
                x, size = _symbols(b.column(2))
                idx, end = b.column(1).to_numpy(), np.cumsum(size)
                chrom = b.column(0)
                breaks = (idx[1:] != idx[:-1] + 1) | (size[:-1] != width) | pc.fill_null(pc.not_equal(chrom[1:], chrom[:-1]), True).to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.flatnonzero(breaks) + 1])
                until = np.append(first[1:], b.num_rows)
                seen = np.minimum(b.column(3).to_numpy() - idx * width, 1 << 40) + end - size
                yield _Stretch(b, x, end - size, np.repeat(end[until - 1], until - first), seen)
                for k, (at, to) in enumerate(zip(first.tolist(), until.tolist(), strict=True)):
                    if k or last is None:
                        head = b.slice(at, min(more, to - at)) if idx[at] > 0 else None
                    elif head is not None and head.num_rows < more:
                        head = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(head.columns, b.slice(last.num_rows, min(more - head.num_rows, to - last.num_rows)).columns, strict=True)], names=columns)
                    if to < b.num_rows and (head is not None or size[to - 1] == width):
                        last = b.slice(max(at, to - more), min(more, to - at))
                        over()
                at = max(int(first[-1]), b.num_rows - more)
                kept = b.slice(at)
                known = np.maximum(kept.column(3).to_numpy(), (idx[-1] + 1) * width)
                last = pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(known)], names=columns)
        if last is not None:
            over()

    def named(batch: pa.RecordBatch, names: list[str], kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(names.index(f.name)).cast(f.type) if f.name in names else pa.nulls(batch.num_rows, f.type) for f in kinds], schema=kinds)

    chrom = StructField("_chrom", tiles.schema["chrom"].dataType)
    both = StructType([*schema.fields, chrom, StructField("_tile_idx", LongType()), StructField("_seq", StringType()), StructField("_seen", LongType())])
    kinds = to_arrow_schema(both)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        torn: list[pa.RecordBatch] = []
        if whole:
            batches = (pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.zeros(b.num_rows, np.int64))], names=columns) for b in intervals.cut(batches, width))
        for found in visit(stretches(batches, torn)):
            yield named(found, own, kinds)
            yield from (named(t, [f"_{c}" for c in columns], kinds) for t in torn)
            torn.clear()
        yield from (named(t, [f"_{c}" for c in columns], kinds) for t in torn)

    given = tiles.select("chrom", F.col("tile_idx").cast("long").alias("tile_idx"), F.upper("seq").alias("seq"), F.lit(0).cast("long").alias("seen"))
    if whole:
        given = intervals.whole_contigs(contigs).withColumn("seq", F.upper("seq"))
    all_ = stages.written(given.mapInArrow(once, both), name)
    torn = all_.where("_tile_idx is not null").select(*(F.col(f"_{c}").alias(c) for c in columns)).withColumn("block", F.floor(F.col("tile_idx") / block))
    before = torn.where((F.col("block") > 0) & (F.col("tile_idx") % block < more)).withColumn("block", F.col("block") - 1).withColumn("seen", F.lit(1 << 62))
    dealt = torn.unionByName(before).repartition("chrom", "block").sortWithinPartitions("chrom", "block", "tile_idx").select(*columns)
    again = dealt.mapInArrow(lambda batches: (named(found, own, to_arrow_schema(schema)) for found in visit(stretches(batches, []))), schema)
    return all_.where("_tile_idx is null").select(*own).unionByName(again)


def _exact(reads: DataFrame, tiles: DataFrame, contigs: DataFrame | None, k: int, sample: int, hot: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(id, b, loci) and (id, repeat) of map_reads for places without an edit.

    The genome is not shuffled: a pass over its tiles hashes every window of the reads' lengths and looks it up in a bitmap of the reads' hashes; windows that pass it are known by their MD5, as reads are. The same
    pass counts the genome's seeds in cells; reads with seeds in a cell above `hot` have theirs counted one by one in another pass."""
    spark = tiles.sparkSession
    keyed = reads.select("id", "strand", F.unhex(F.md5("s")).alias("key"), "s")

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                yield b.take(pa.array(np.unique(_text_seeds(b.column(1), k, sample)[0])))

    texts = keyed.select("key", "s").dropDuplicates(["key"])
    texts = stages.written(texts.mapInArrow(seeded, texts.schema), "read-texts")
    sizes = {r["n"]: r["count"] for r in texts.groupBy(F.length("s").alias("n")).count().collect()}
    log = _log(sum(sizes.values()))
    # a text is looked up by a power of two of its first symbols, then by all of it
    lengths = {b: sorted(n for n in sizes if n.bit_length() == b.bit_length()) for b in {1 << n.bit_length() - 1 for n in sizes}}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                x, size = _symbols(b.column(0))
                rolled, start = _Rolled(x), np.cumsum(size) - size
                short = 1 << np.frexp(size)[1].astype(np.int64) - 1
                for n, tag in ((short, 2 * short), (size, 2 * size + 1)):
                    yield pa.RecordBatch.from_arrays([pa.array(_spots(rolled.at(start, n), tag, log))], names=["spot"])

    bits = _bitmap(texts.select("s").mapInArrow(marked, "spot long"), log)

    def matched(stretches: Iterator[_Stretch]) -> Iterator[pa.RecordBatch]:
        table, count = bits.value, np.zeros(1 << CELLS, np.int64)
        for s in stretches:
            count += np.bincount(_cells(_seed_hashes(s.x, k, sample)[1]), minlength=len(count))
            rolled, found = _Rolled(s.x), []
            for b, of in lengths.items():
                i = _known(table, rolled.all(b), 2 * b)
                t = s.tile(i)
                for n in of:
                    ok = s.new(i, t, n)
                    j, u = i[ok], t[ok]
                    ok = _known(table, rolled.at(j, n), 2 * n + 1)
                    found.append((j[ok], u[ok], np.full(len(ok), n)))
            i, t, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            wide, raw = s.x.itemsize, s.x.tobytes()
            parts = (raw[wide * a : wide * (a + m)] for a, m in zip(i.tolist(), n.tolist(), strict=True))
            keys = [hashlib.md5(p if wide == 1 else p.decode("utf-32-le").encode()).digest() for p in parts]
            place = s.tiles.column(1).to_numpy()[t] * width + i - s.start[t]
            none = pa.nulls(len(i), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), s.tiles.column(0).take(pa.array(t)), pa.array(place), pa.array(place + n), none, pa.nulls(len(i), pa.binary())], names=["key", "chrom", "start", "end", "block", "counts"])
        parts = [zlib.compress(x.tobytes(), 1) for x in count.reshape(BLOCKS, -1)] if count.any() else []
        none = [pa.nulls(len(parts), x) for x in (pa.binary(), pa.null(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(len(parts))), pa.array(parts, pa.binary())], names=["key", "chrom", "start", "end", "block", "counts"])

    long = [StructField(c, LongType()) for c in ("start", "end", "block")]
    schema = StructType([StructField("key", BinaryType()), StructField("chrom", tiles.schema["chrom"].dataType), *long, StructField("counts", BinaryType())])
    swept = _swept(tiles, contigs, width, max(sizes, default=1), matched, schema, "read-places")

    def full(t: pa.Table) -> pa.Table:
        count = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in t.column("counts").to_pylist())
        cell = np.flatnonzero(count > hot)
        return pa.table({"cell": pa.array(cell + t.column("block")[0].as_py() * len(count))})

    cells = np.array([r["cell"] for r in swept.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(full, "cell long").collect()], np.int64)
    met = swept.where("key is not null").groupBy("key").agg(F.min(F.struct("chrom", "start", "end")).alias("p"), F.count("*").alias("n"))
    if len(cells):
        rarest = stages.written(_rarest(keyed, texts, tiles, contigs, k, sample, width, cells), "rarest")
        met = met.join(rarest.where(F.col("n") > hot), "key", "left_anti")
        known = keyed.join(rarest, "key").groupBy("id").agg((F.min("n") > hot).alias("repeat"))
    else:
        known = spark.createDataFrame([], StructType([keyed.schema["id"], StructField("repeat", BooleanType())]))
    best = F.min(F.struct(F.lit(0).alias("edits"), F.col("p.chrom").alias("chrom"), F.col("p.start").alias("start"), "strand", F.col("p.end").alias("end")))
    found = keyed.select("id", "strand", "key").join(met, "key").groupBy("id").agg(best.alias("b"), F.sum("n").alias("loci"))
    return found, known


def _rarest(keyed: DataFrame, texts: DataFrame, tiles: DataFrame, contigs: DataFrame | None, k: int, sample: int, width: int, cells: np.ndarray) -> DataFrame:
    """(key, n): how often the genome has the rarest of a text's seeds that it has, for the texts of all ids with a seed in one of the cells."""
    ids = keyed.join(_runs(texts, k, sample, cells).select("key").distinct(), "key", "left_semi").select("id").distinct()
    mine = stages.written(_runs(texts.join(keyed.join(ids, "id", "left_semi").select("key"), "key", "left_semi"), k, sample), "read-seeds")
    wanted = stages.written(mine.select("h").distinct(), "seeds")
    log = _log(wanted.count())

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_spots(b.column(0).to_numpy().view(np.uint64), 0, log))], names=["spot"])

    bits = _bitmap(wanted.mapInArrow(marked, "spot long"), log)

    def counted(stretches: Iterator[_Stretch]) -> Iterator[pa.RecordBatch]:
        for s in stretches:
            i, h = _seed_hashes(s.x, k, sample)
            ok = _known(bits.value, h, 0)
            i, h = i[ok], h[ok]
            h, n = np.unique(h[s.new(i, s.tile(i), k)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    count = _swept(tiles, contigs, width, k, counted, StructType([StructField("h", LongType()), StructField("n", LongType())]), "seed-counts").groupBy("h").agg(F.sum("n").alias("n"))
    return mine.join(count, "h").groupBy("key").agg(F.min("n").alias("n"))


def _near(both: DataFrame, tiles: DataFrame, k: int, sample: int, hot: int, max_edits: int, band: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(id, b, loci) and (id, repeat) of map_reads for places with edits: clusters of the hits of all seeds."""
    mine = stages.written(both.select("id", "strand", F.explode(_seeds(F.col("s"), k, sample)).alias("x")).select("id", "strand", "x.at", "x.h"), "read-seeds")
    theirs = stages.written(genome_seeds(tiles, k, sample, width).join(mine.select("h").distinct(), "h", "left_semi"), "genome-seeds")
    count = theirs.groupBy("h").agg(F.count("*").alias("n"))
    cold = theirs.join(count.where(F.col("n") <= hot), "h").select("h", "chrom", "pos")
    hits = mine.join(cold, "h").groupBy("id", "strand", "chrom", (F.col("pos") - F.col("at")).alias("diag")).agg(F.count("*").alias("seeds"))
    # a read has as many offsets on a chromosome as its seeds have places there: `hot` times its seeds at most
    w = Window.partitionBy("id", "strand", "chrom").orderBy("diag")
    hits = hits.withColumn("_new", F.when(F.col("diag") - F.lag("diag").over(w) <= band, 0).otherwise(1)).withColumn("_cluster", F.sum("_new").over(w))
    places = hits.groupBy("id", "strand", "chrom", "_cluster").agg(F.max_by("diag", F.struct("seeds", -F.col("diag"))).alias("diag")).join(both, ["id", "strand"])
    spans = places.select("id", "strand", "chrom", F.greatest("diag", F.lit(0)).alias("start"), (F.col("diag") + F.length("s")).alias("end"), "s")
    checked = intervals.get_fasta(spans, tiles, width).withColumn("edits", F.levenshtein("s", F.upper("sequence"), max_edits)).where(F.col("edits") >= 0)
    best = F.min(F.struct("edits", "chrom", "start", "strand", (F.col("start") + F.length("sequence")).alias("end")))
    found = checked.groupBy("id").agg(best.alias("b"), F.count("*").alias("loci"))
    known = mine.join(count, "h").groupBy("id").agg((F.min("n") > hot).alias("repeat"))
    return found, known


def map_reads(reads: DataFrame, tiles: DataFrame, k: int = 21, sample: int = 8, hot: int = 256, max_edits: int = 20, band: int = 40, width: int = WIDTH, contigs: DataFrame | None = None) -> DataFrame:
    """(id, chrom, start, end, strand, edits, loci, unique) of each read (id, seq): its best place, the number of places within `max_edits`, and whether it is the only one.

    Places are clusters of seed hits whose offsets lie within `band`; a place is checked over the read's length. Seeds with more than `hot` places in the genome bring no candidates; a read all of whose
    seeds that the genome has are such is a repeat: not unique, its number of places null. Reads without a place have 0 and are not unique. Ids name one read; repeated rows count once; a null
    sequence has no place. Of equally good places the first by chromosome, start and strand is named. `contigs` (chrom, seq, len), of which the tiles are cut, spare a pass without edits the tiles' way through Spark."""
    given = reads.select("id", F.upper("seq").alias("seq")).distinct()
    if max_edits == 0 and band == 0:
        given = stages.written(given, "reads")
    both = given.select("id", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("s")), F.struct(F.lit("-").alias("strand"), seq.revcomp(F.col("seq")).alias("s")))).alias("x")).select("id", "x.strand", "x.s").where("s is not null")
    if max_edits == 0 and band == 0:
        found, known = _exact(both, tiles, contigs, k, sample, hot, width)
    else:
        found, known = _near(both, tiles, k, sample, hot, max_edits, band, width)
    out = given.select("id").distinct().join(found, "id", "left").join(known, "id", "left")
    repeat = F.coalesce("repeat", F.lit(False))
    loci = F.when(repeat, F.lit(None)).otherwise(F.coalesce("loci", F.lit(0)))
    return out.select("id", "b.chrom", "b.start", "b.end", "b.strand", "b.edits", loci.cast("bigint").alias("loci"), (F.coalesce(loci, F.lit(0)) == 1).alias("unique"))
