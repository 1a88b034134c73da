"""Interval algebra on (chrom, start, end), 0-based and half-open.

Window operators over one chromosome are cut into stretches of STRETCH bases first where the algebra allows, so that one large
chromosome does not become one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandflow.functions import stages

from . import scan

BIN = 1 << 14
STRETCH = 1 << 20
BATCH = 8 << 20  # symbols of tiles that leave a task at once


def _binned(df: DataFrame, width: int) -> DataFrame:
    first, last = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    return df.where("end > start").withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals: columns of a, and those of b with the suffix _b.

    Both sides are spread over bins of `width` bases and joined on (chrom, bin); a pair counts in the bin where the
    later start lies, once. how: inner, left_semi or left_anti (rows of a with or without a partner). Empty intervals overlap nothing."""
    right = _binned(b, width).select(F.col("chrom").alias("_chrom"), F.col("_bin").alias("_bin_b"), *(F.col(c).alias(f"{c}_b") for c in b.columns if c != "chrom"))
    meets = (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_bin_b")) & (F.col("start") < F.col("end_b")) & (F.col("end") > F.col("start_b"))
    once = F.col("_bin") == F.floor(F.greatest("start", "start_b") / width)
    if how == "inner":
        return _binned(a, width).join(right, meets & once).drop("_chrom", "_bin", "_bin_b")
    # rows are known by their own values, which do not change when a side is computed again
    hit = _binned(a.select("chrom", "start", "end").distinct(), width).join(right.select("_chrom", "_bin_b", "start_b", "end_b"), meets, "left_semi").select("chrom", "start", "end").distinct()
    return a.join(hit, ["chrom", "start", "end"], how).select(*a.columns)


def overlap_totals(queries: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("chrom",), width: int = BIN) -> DataFrame:
    """(keys, start, end, n, bp): of each different interval of queries that some of b overlap on the same keys, how many do and the bases shared, one interval at a time.

    No pair is made: equal bounds are counted first, running sums over them give how many start before an interval's end and how many end before its start, so work
    grows with rows and not with depth. Empty intervals overlap nothing."""
    bound = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("e")), F.struct(F.col("end").alias("at"), F.lit(0).cast("bigint").alias("s"), F.lit(1).cast("bigint").alias("e"))))
    spans = b.where("end > start").groupBy(*keys, "start", "end").agg(F.count("*").alias("_n"))
    bounds = spans.select(*keys, "_n", bound.alias("x")).groupBy(*keys, F.col("x.at").alias("at")).agg(F.sum(F.col("x.s") * F.col("_n")).alias("s"), F.sum(F.col("x.e") * F.col("_n")).alias("e"))
    side = F.explode(F.array(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint")))
    asked = queries.where("end > start").select(*keys, "start", "end").distinct().select("*", side.alias("side")).withColumn("at", F.when(F.col("side") < 0, F.col("start")).otherwise(F.col("end")))
    both = stages.written(bounds.unionByName(asked, allowMissingColumns=True), "bounds")
    # at one place ends come before questions and starts after them; a null side is a bound
    kind = F.when(F.col("side").isNotNull(), 1).when(F.col("e") > 0, 0).otherwise(2)
    apart = both.where("side is not null or s = 0 or e = 0").unionByName(both.where("s > 0 and e > 0").select(*keys, "at", "start", "end", "side", F.explode(F.array(F.struct(F.col("s").alias("s"), F.lit(0).cast("bigint").alias("e")), F.struct(F.lit(0).cast("bigint").alias("s"), F.col("e").alias("e")))).alias("x")).select(*keys, "at", "start", "end", "side", "x.s", "x.e"))
    runs = {"starts": ("sum", F.col("s")), "ends": ("sum", F.col("e")), "base": ("sum", F.col("at") * (F.col("s") - F.col("e")))}
    at = scan.prefix(apart, runs, F.floor(F.col("at") / width), (F.col("at"), kind), keys).where("side is not null")
    shared = F.col("at") * (F.col("starts") - F.col("ends")) - F.col("base")
    n = F.when(F.col("side") > 0, F.col("starts")).otherwise(-F.col("ends"))
    return at.groupBy(*keys, "start", "end").agg(F.sum(n).alias("n"), F.sum(F.col("side") * shared).alias("bp")).where("n > 0")


def merge(df: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """(keys, start, end, n): intervals merged where the next starts at most `gap` after the furthest end so far.

    Stretches are merged apart, then what is left of them together."""
    first = _merge(df.select(*keys, "start", "end", F.lit(1).cast("bigint").alias("n")).withColumn("_s", F.floor(F.col("start") / STRETCH)), gap, (*keys, "_s"))
    return _merge(first.drop("_s"), gap, keys)


def _merge(df: DataFrame, gap: int, keys: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("_before").isNull() | (F.col("start") - F.col("_before") > gap), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_before", before).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_island")


def complement(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, start, end): what the intervals leave of each contig of sizes (chrom, len), contigs without intervals included."""
    m = merge(df).join(sizes, "chrom")
    w = Window.partitionBy("chrom").orderBy("start")
    inner = m.select("chrom", F.coalesce(F.lag("end").over(w), F.lit(0)).alias("s"), F.col("start").alias("e"))
    tail = m.groupBy("chrom", "len").agg(F.max("end").alias("s")).select("chrom", "s", F.col("len").alias("e"))
    bare = sizes.join(df.select("chrom").distinct(), "chrom", "left_anti").select("chrom", F.lit(0).cast("bigint").alias("s"), F.col("len").alias("e"))
    return inner.unionByName(tail).unionByName(bare).where("s < e").select("chrom", F.col("s").alias("start"), F.col("e").alias("end"))


def neighbour_overlap(queries: DataFrame, intervals: DataFrame) -> DataFrame:
    """queries with `near`: whether the last interval that starts before the query, or the first that does not, overlaps it.

    The neighbour rule of a sorted list; unlike overlap_join it misses a long earlier interval behind a short one."""
    q = queries.select("*", F.lit(1).alias("_kind"), F.col("start").alias("_at"))
    i = intervals.select("chrom", F.col("start").alias("_is"), F.col("end").alias("_ie"), F.lit(0).alias("_kind"), F.col("start").alias("_at"))
    both = q.unionByName(i, allowMissingColumns=True)
    key = F.struct("_is", "_ie")
    only = F.when(F.col("_kind") == 0, key)
    stretch = F.floor(F.col("_at") / STRETCH)
    # the last interval so far is the largest one, the next one the smallest
    marked = scan.prefix(both, {"_p": ("max", only)}, stretch, (F.col("_at"), F.desc("_kind"), F.col("_ie")), ("chrom",), inclusive=False)
    marked = scan.prefix(marked, {"_n": ("min", only)}, -stretch, (F.desc("_at"), F.col("_kind"), F.desc("_ie")), ("chrom",), inclusive=False).where("_kind = 1")
    meets = lambda x: F.coalesce((F.col("start") < F.col(f"{x}._ie")) & (F.col("end") > F.col(f"{x}._is")), F.lit(False))
    return marked.withColumn("near", meets("_p") | meets("_n")).select(*queries.columns, "near")


def liftover(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """Parts of intervals mapped through alignment blocks (chrom, start, end, to_chrom, to_start, to_strand), strand-aware."""
    j = overlap_join(df, blocks)
    lo, hi = F.greatest("start", "start_b"), F.least("end", "end_b")
    plus = F.col("to_strand_b") == "+"
    s = F.when(plus, F.col("to_start_b") + lo - F.col("start_b")).otherwise(F.col("to_start_b") + F.col("end_b") - hi)
    return j.select("name", F.col("to_chrom_b").alias("chrom"), s.alias("start"), (s + hi - lo).alias("end"), F.col("to_strand_b").alias("strand"))


def cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(chrom, tile_idx, seq, len) of contigs (chrom, len, seq). Tiles are new bounds over the same bytes."""
    step = max(1, BATCH // width)
    for batch in batches:
        text = batch.column(2).cast(pa.large_string())
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        at, first = off - off[0], None
        if len(data) and data.max() > 127:  # symbols of several bytes
            first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            at = np.searchsorted(first, at)
        tiles = -(-np.diff(at) // width)
        row = np.repeat(np.arange(len(tiles)), tiles)
        idx = np.arange(len(row)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
        bounds = np.append(at[row] + idx * width, at[-1])
        bounds = bounds if first is None else first[bounds]
        for a in range(0, len(row), step):
            b = min(a + step, len(row))
            own = pa.array(row[a:b])
            seqs = pa.StringArray.from_buffers(b - a, pa.py_buffer((bounds[a : b + 1] - bounds[a]).astype(np.int32)), pa.py_buffer(data[bounds[a] : bounds[b]].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array(idx[a:b]), seqs, batch.column(1).take(own)], names=["chrom", "tile_idx", "seq", "len"])


def whole_contigs(genome: DataFrame) -> DataFrame:
    return genome.where("len > 0 and seq is not null").select("chrom", "len", "seq")


def tile(genome: DataFrame, width: int = 256) -> DataFrame:
    """(chrom, tile_idx, seq, len): contigs cut into tiles in one pass, so that no long contig is shuffled or copied for each tile."""
    given = whole_contigs(genome)
    schema = StructType([given.schema["chrom"], StructField("tile_idx", LongType()), StructField("seq", StringType()), given.schema["len"]])
    return given.mapInArrow(lambda batches: cut(batches, width), schema)


def get_fasta(df: DataFrame, tiles: DataFrame, width: int = 256, key: str = "name") -> DataFrame:
    """df with `sequence`: the bases of each interval, read from the tiles it touches. Past the end there is what there is; intervals without
    bases or on unknown contigs give no row. Every row of df has its own result, repeated rows too. An interval inside a tile is cut from it at once; equal ones that
    touch several are read once."""
    t = tiles.select(F.col("chrom").alias("_chrom"), F.col("tile_idx").alias("_tile_idx"), F.col("seq").alias("_tile"))
    meets = (F.col("chrom") == F.col("_chrom")) & (F.col("_at") == F.col("_tile_idx"))
    first, last = F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}")
    lo = F.greatest(F.col("start") - F.col("_at") * width, F.lit(0).cast("bigint"))
    hi = F.least(F.col("end") - F.col("_at") * width, F.lit(width).cast("bigint"))
    piece = F.substring("_tile", (lo + 1).cast("int"), (hi - lo).cast("int"))
    rows = df.where("end > start")
    one = rows.where(first == last).withColumn("_at", first).join(t, meets).select(*df.columns, piece.alias("sequence"))
    more = rows.where(first < last)
    j = more.select("chrom", "start", "end").distinct().withColumn("_at", F.explode(F.sequence(first, last))).join(t, meets)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", piece.alias("s")))), lambda x: x["s"]), "")
    long = j.groupBy("chrom", "start", "end").agg(joined.alias("sequence"))
    return one.unionByName(more.join(long, ["chrom", "start", "end"]).select(*df.columns, "sequence"))


def fetch_regions(regions: DataFrame, tiles: DataFrame, width: int = 256, region: str = "region") -> DataFrame:
    """regions with `sequence`, from strings `contig:first-last` (1-based, both ends included) or `contig:place`, by the tiles they touch only.

    A string of another form, or of a region without bases, gives no row."""
    part = lambda k: F.regexp_extract(region, r"^(.+):([0-9]+)(?:-([0-9]+))?$", k)
    first, last = part(2).try_cast("bigint"), F.coalesce(part(3).try_cast("bigint"), part(2).try_cast("bigint"))
    r = regions.select("*", part(1).alias("chrom"), (first - 1).alias("start"), last.alias("end")).where("start is not null")
    return get_fasta(r, tiles, width, region).select(*regions.columns, "sequence")


def stitch(tiles: DataFrame) -> DataFrame:
    """(chrom, seq): contigs rebuilt from their tiles."""
    return tiles.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile_idx", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def span_mean(spans: DataFrame, signal: DataFrame) -> DataFrame:
    """spans with `mean`: the signal's mean over each span; bases without a run count as 0. Empty spans and those with a null bound have no mean, spans on
    a null contig one of 0; repeated rows have each their own.

    Spans inside one bin are summed where they meet that bin's runs, with one shuffle; only those that cross bins have parts to bring together."""
    first, last = F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN)
    part = F.least("end", "end_b") - F.greatest("start", "start_b")
    total = F.sum(F.col("value_b") * part).alias("_v")
    mean = (F.coalesce(F.col("_v"), F.lit(0.0)) / F.nullif(F.col("end") - F.col("start"), F.lit(0))).alias("mean")
    near = F.coalesce((F.col("end") > F.col("start")) & (first == last) & F.col("chrom").isNotNull(), F.lit(False))
    far = spans.where(~near)
    got = overlap_join(far.select("chrom", "start", "end").distinct(), signal).groupBy("chrom", "start", "end").agg(total)
    crossing = far.join(got, ["chrom", "start", "end"], "left").select(*spans.columns, mean)
    others = [c for c in spans.columns if c != "chrom"]
    # dealt by bin once: equal rows, runs and sums all meet there
    rows = spans.where(near).withColumn("_bin", first).repartition("chrom", "_bin").groupBy("chrom", "_bin", *others).agg(F.count("*").cast("int").alias("_rows"))
    runs = _binned(signal.select("chrom", "start", "end", "value"), BIN).select(F.col("chrom").alias("_chrom"), F.col("_bin").alias("_bin_b"), F.col("start").alias("start_b"), F.col("end").alias("end_b"), F.col("value").alias("value_b"))
    meets = (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_bin_b")) & (F.col("start") < F.col("end_b")) & (F.col("end") > F.col("start_b"))
    inside = rows.join(runs, meets, "left").groupBy("chrom", "_bin", *others, "_rows").agg(total)
    each = inside.select(*spans.columns, mean, F.explode(F.array_repeat(F.lit(1), F.col("_rows"))))
    return crossing.unionByName(each.select(*spans.columns, "mean"))


def length_sum(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("bp"), F.count("*").alias("n"))


def token_coordinates(tokens: DataFrame, left: Column, right: Column, strand: Column) -> DataFrame:
    """tokens (sample, pos, length) with genomic start and end: forward from the left end on +, backward from the right end on -."""
    w = Window.partitionBy("sample").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    done = F.sum("length").over(w)
    t = tokens.withColumn("_d", done)
    return t.withColumn("tok_start", F.when(strand == "+", left + F.col("_d") - F.col("length")).otherwise(right - F.col("_d"))).withColumn("tok_end", F.col("tok_start") + F.col("length")).drop("_d")
