"""Labelled datasets composed of the interval, window and sampling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import seq, stages

from . import intervals, samples, windows


def peak_classification(peaks: DataFrame, tiles: DataFrame, sizes: DataFrame, length: int, tries: tuple[int, int], seed: str, test: tuple[str, ...], valid: tuple[str, ...], width: int = 256) -> DataFrame:
    """(chrom, start, end, sequence, label, split): N-free windows around peaks, and as many free negatives a chromosome."""
    c = windows.centre(F.col("start"), F.col("end"), F.lit(-1))
    p = peaks.join(sizes, "chrom").withColumn("c", c)
    s, e = windows.clamped(F.col("c"), length, F.col("len"))
    w = p.select("chrom", s.alias("start"), e.alias("end")).where(F.col("end") - F.col("start") == length).distinct()
    clean = lambda df: intervals.get_fasta(df, tiles, width).where((F.length("sequence") == length) & (F.instr("sequence", "N") == 0))
    pos = stages.written(clean(w), "positives")
    wanted = pos.groupBy("chrom").agg(F.count("*").alias("n"))
    neg = windows.negatives(wanted, sizes, peaks, length, tries, seed).select("chrom", "start", "end")
    both = pos.withColumn("label", F.lit(1)).unionByName(clean(neg.distinct()).withColumn("label", F.lit(0)))
    return samples.by_chromosome(both, valid, test)


def peak_regression(peaks: DataFrame, sizes: DataFrame, length: int, shift: int, tries: tuple[int, int], seed: str, test: tuple[str, ...], valid: tuple[str, ...]) -> DataFrame:
    """(chrom, start, end, label, split): jittered windows that overlap a peak, and free negatives. Bases are not looked at."""
    c = windows.jitter(windows.centre(F.col("start"), F.col("end"), F.lit(-1)), shift, seed, F.col("name"))
    p = peaks.join(sizes, "chrom").withColumn("c", c)
    s, e = windows.clamped(F.col("c"), length, F.col("len"))
    w = p.select("chrom", s.alias("start"), e.alias("end")).where(F.col("end") - F.col("start") == length).distinct()
    pos = stages.written(intervals.overlap_join(w, peaks.select("chrom", "start", "end"), how="left_semi"), "positives")
    neg = windows.negatives(pos.groupBy("chrom").agg(F.count("*").alias("n")), sizes, peaks, length, tries, seed).select("chrom", "start", "end")
    return samples.by_chromosome(pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0))), valid, test)


def promoter_dataset(sequences: DataFrame, length: int, seed: str, blocks: int = 20, moved: int = 12) -> DataFrame:
    """(name, sequence, promoter_presence): sequences cut to `length`, each with a block-shuffled negative.

    A cut sequence that does not divide into the blocks raises, as the reference's assertion does."""
    p = sequences.withColumn("sequence", F.substring("sequence", 1, length))
    neg = p.withColumn("sequence", samples.block_shuffle(F.col("sequence"), F.col("name"), seed, blocks, moved))
    both = p.select("name", "sequence", F.lit(1).alias("promoter_presence")).unionByName(neg.select("name", "sequence", F.lit(0).alias("promoter_presence")))
    return both


def holdout(reference: DataFrame, blocks: DataFrame, sizes: DataFrame, tiles: DataFrame, genome: str, gap: int = 10_000, width: int = 256) -> tuple[DataFrame, DataFrame]:
    """(stats, records): holdout intervals lifted to a genome and merged; sequences of both splits with their names."""
    lifted = intervals.liftover(reference, blocks).select("chrom", "start", "end")
    merged = stages.written(intervals.merge(lifted, gap), "holdout")
    stats = intervals.length_sum(lifted).select(F.col("bp").alias("test_size_before_merge")).crossJoin(intervals.length_sum(merged).select(F.col("bp").alias("test_after_merge"), F.col("n").alias("n_test_intervals")))  # one row each
    name = lambda split: F.concat_ws("_", F.lit(genome), "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.lit(split))
    test = merged.select("chrom", "start", "end", name("test").alias("name"))
    train = intervals.complement(merged, sizes).select("chrom", "start", "end", name("train").alias("name"))
    return stats, intervals.get_fasta(stages.written(test.unionByName(train), "splits"), tiles, width).select("name", "sequence")


def extended_context(rows: DataFrame, hits: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """rows (id, seq) refetched `size` long around their unique hit (id, chrom, mid); unmapped or short ones keep their own bases."""
    s, e = windows.left_clamped(F.col("mid"), size)
    got = intervals.get_fasta(hits.select(F.col("id").cast("string").alias("name"), "chrom", s.alias("start"), e.alias("end")), tiles).where(F.length("sequence") == size)
    j = rows.withColumn("name", F.col("id").cast("string")).join(got.select("name", "sequence"), "name", "left")
    return j.select("id", F.coalesce("sequence", "seq").alias("seq"), F.col("sequence").isNotNull().alias("mapped"))


def variant_sequences(variants: DataFrame, regions: DataFrame, tiles: DataFrame, width: int = 256) -> DataFrame:
    """(id, name, ref_seq, alt_seq): each region with and without each variant inside it, on the region's strand.

    A variant whose reference differs from the genome raises."""
    at = variants.select("chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end"), "pos", "ref", "alt", "id")
    # pairs first: bases join them last and are not shuffled again
    met = intervals.overlap_join(regions, at).where((F.col("start_b") >= F.col("start")) & (F.col("end_b") <= F.col("end")))
    j = intervals.get_fasta(stages.written(met, "variant-pairs"), tiles, width)
    p = F.col("pos_b") - F.col("start")
    seen = F.substring("sequence", p.cast("int"), F.length("ref_b"))
    ok = F.when(seen != F.col("ref_b"), F.raise_error(F.concat(F.lit("reference differs at "), F.col("id_b").cast("string"))).cast("string")).otherwise(F.col("sequence"))
    turn = lambda c: F.when(F.col("strand") == "-", seq.revcomp(c)).otherwise(c)
    return j.select(F.col("id_b").alias("id"), "name", turn(ok).alias("ref_seq"), turn(seq.substitute(F.col("sequence"), p, F.col("ref_b"), F.col("alt_b"))).alias("alt_seq"))
