"""Windows around centres, strand-aware extension, jitter and hash-sampled negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions import rng, stages

from . import intervals, scan


def centre(start: Column, end: Column, summit: Column) -> Column:
    """start + summit, or the middle where the summit is null or negative."""
    return F.when(summit >= 0, start + summit).otherwise(F.floor((start + end) / 2))


def clamped(c: Column, length: int, size: Column) -> tuple[Column, Column]:
    """Window of `length` around c, shifted to lie inside [0, size); shorter contigs give shorter windows."""
    s0 = F.greatest(F.lit(0).cast("bigint"), c - length // 2)
    over = s0 + length > size
    return F.when(over, F.greatest(F.lit(0).cast("bigint"), size - length)).otherwise(s0), F.when(over, size).otherwise(s0 + length)


def centred(start: Column, end: Column, length: int) -> tuple[Column, Column]:
    mid = F.floor((start + end) / 2)
    return mid - length // 2, mid - length // 2 + length


def left_clamped(c: Column, length: int) -> tuple[Column, Column]:
    s = F.greatest(c - length // 2, F.lit(0).cast("bigint"))
    return s, s + length


def extended(start: Column, end: Column, strand: Column, left: int, right: int) -> tuple[Column, Column]:
    """left bases before and right bases after, in the direction of the strand; other strands raise."""
    bad = F.raise_error(F.concat(F.lit("unknown strand "), strand)).cast("bigint")
    return F.when(strand == "+", start - left).when(strand == "-", start - right).otherwise(bad), F.when(strand == "+", end + right).when(strand == "-", end + left).otherwise(bad)


def jitter(c: Column, shift: int, *keys: Column | str) -> Column:
    return c + rng.between(-shift, shift, *keys)


def negatives(wanted: DataFrame, sizes: DataFrame, avoid: DataFrame, length: int, tries: tuple[int, int], seed: str) -> DataFrame:
    """(chrom, start, end, try): for each row of wanted (chrom, n) the first n random windows that overlap nothing of avoid.

    Candidates are max(tries[0], tries[1] * n) hash draws a chromosome; contigs not longer than the window have none. Fewer
    than n come back where the tries run out."""
    c = wanted.join(sizes, "chrom").where(F.col("len") > length)
    c = c.withColumn("try", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(tries[0]).cast("bigint"), F.col("n") * tries[1]))))
    start = rng.between(F.lit(0).cast("bigint"), F.col("len") - length, seed, F.col("chrom"), F.col("try").cast("string"))
    c = c.select("chrom", "n", "try", start.alias("start")).withColumn("end", F.col("start") + length)
    free = stages.written(intervals.overlap_join(c, avoid.select("chrom", "start", "end"), how="left_anti"), "free")
    return scan.position(free, "_k", scan.number_bucket(F.col("try")), (F.col("try"),), ("chrom",)).where("_k <= n").select("chrom", "start", "end", "try")
