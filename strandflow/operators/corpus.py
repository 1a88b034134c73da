"""Pre-training corpora: documents of sentences cut from contigs of both strands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import rng, seq, stages

from . import intervals

TILE = 1024


def both_strands(genome: DataFrame) -> DataFrame:
    """Each contig and its reverse complement, named rc_<contig>: one scan of the genome."""
    # bases stay outside what is exploded, so that they are not read where only lengths are asked for
    both = genome.select("chrom", "seq", "len", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    return both.select(F.when(F.col("back"), F.concat(F.lit("rc_"), "chrom")).otherwise(F.col("chrom")).alias("chrom"), F.when(F.col("back"), seq.revcomp_iupac(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), "len")


def sentences(genome: DataFrame, seed: str, start: int = 5000, sentence: tuple[int, int] = (500, 1000), document: tuple[int, int] = (50, 100)) -> DataFrame:
    """(chrom, sentence_idx, doc_idx, start, len): cuts of each contig, without bases.

    The first sentence starts at a hash draw in [0, start]; lengths and sentences per document are draws too. The last
    sentence ends with the contig. Sentence numbers run within a document of the same contig."""
    lo, hi = sentence
    g = genome.select("chrom", "len", rng.between(0, start, seed, "q", F.col("chrom")).alias("q0")).where("q0 < len")
    idx = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("len") - F.col("q0")) / lo)))
    s = g.select("chrom", "len", "q0", idx.alias("sentence_idx"))
    s = s.withColumn("n", rng.between(lo, hi, seed, "s", F.col("chrom"), F.col("sentence_idx").cast("string")))
    w = Window.partitionBy("chrom").orderBy("sentence_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("start", F.col("q0") + F.coalesce(F.sum("n").over(w), F.lit(0))).where("start < len")
    dlo, dhi = document
    count = s.groupBy("chrom").agg(F.count("*").alias("m"))
    b = count.select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("m") / dlo))).alias("doc_idx"))
    b = b.withColumn("k", rng.between(dlo, dhi, seed, "d", F.col("chrom"), F.col("doc_idx").cast("string")))
    wd = Window.partitionBy("chrom").orderBy("doc_idx").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("upto", F.sum("k").over(wd)).select("chrom", "doc_idx", (F.col("upto") - F.col("k")).alias("low"), "upto")
    # a document's sentences fall into two bins of sentence numbers at most
    bins = b.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("low") / dhi), F.floor((F.col("upto") - 1) / dhi))))
    j = s.withColumn("_bin", F.floor(F.col("sentence_idx") / dhi)).join(bins, ["chrom", "_bin"]).where("sentence_idx >= low and sentence_idx < upto")
    return j.select("chrom", "sentence_idx", "doc_idx", "start", F.least("n", F.col("len") - F.col("start")).alias("n"))


def documents(genome: DataFrame, seed: str, **options) -> DataFrame:
    """(chrom, doc_idx, text): documents as arrays of upper-case sentences. Bases come from tiles, so no sentence carries its contig."""
    s = stages.written(sentences(genome.select("chrom", "len"), seed, **options).withColumn("end", F.col("start") + F.col("n")), "sentences")
    j = intervals.get_fasta(s, intervals.tile(genome, TILE), TILE).select("chrom", "doc_idx", "sentence_idx", F.upper("sequence").alias("s"))
    return j.groupBy("chrom", "doc_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("sentence_idx", "s"))), lambda x: x["s"]).alias("text"))
