"""Command lines: `python -m strandflow.cli corpus ...` and `... alleles ...` build corpora from files with the library's operators."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandflow.operators import corpus, haplotypes, intervals, variants
from strandflow.sources import fasta_ranges, files, readers, vcf_indexed, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandflow")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("corpus", help="documents of sentences from both strands of a FASTA file's contigs")
    c.add_argument("--input-file", required=True)
    c.add_argument("--contigs-split-file", help="CSV of (name, intervals): parts that contigs are split into")
    c.add_argument("--output-dir", required=True)
    c.add_argument("--io-mode", choices=sorted(writers.MODES), default="single_txt")
    c.add_argument("--min-len", type=int, default=10_000, help="least length of a contig")
    c.add_argument("--n_augmentations", type=int, default=10, help="how often each contig is cut anew, from another start")
    a = commands.add_parser("alleles", help="documents of sentences from both haplotypes of a VCF file's samples, on both strands")
    a.add_argument("--reference", required=True)
    a.add_argument("--vcf", required=True)
    a.add_argument("--samples", help="comma-separated; all where it is missing")
    a.add_argument("--whole", action="store_true", help="whole contigs in place of documents: for short ones only, as a haplotype is one cell then")
    a.add_argument("--min-density", type=float, default=0.01, help="least genotyped sites a base of a document")
    a.add_argument("--max-n", type=float, default=0.5, help="largest share of N of a document")
    a.add_argument("--sentence", type=int, nargs=2, default=(500, 1000), help="least and largest length of a sentence")
    a.add_argument("--document", type=int, nargs=2, default=(50, 100), help="least and largest number of a document's sentences")
    a.add_argument("--start", type=int, default=5000, help="the first document starts at a draw up to this place")
    a.add_argument("--output-dir", required=True)
    a.add_argument("--io-mode", choices=sorted(writers.MODES), default="jsonl")
    return p


def build_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.n_augmentations < 1:
        raise ValueError("n_augmentations must be above 0")
    g = readers.fasta(spark, a.input_file).select(F.col("id").alias("chrom"), "seq")
    if a.contigs_split_file:
        parts = readers.contig_breaks(spark, a.contigs_split_file).withColumnRenamed("name", "chrom")
        g = g.join(parts, "chrom").select(F.concat_ws("_", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("chrom"), F.expr("substring(seq, int(start + 1), int(end - start))").alias("seq"))
    g = corpus.both_strands(g.withColumn("len", F.length("seq").cast("bigint")).where(F.col("len") >= a.min_len))
    whole = None
    for k in range(a.n_augmentations):
        d = corpus.documents(g, f"corpus-{k}").withColumn("doc_idx", F.concat_ws("_", F.lit(k).cast("string"), F.col("doc_idx").cast("string")))
        whole = d if whole is None else whole.unionByName(d)
    writers.MODES[a.io_mode](whole, a.output_dir)


def build_alleles(spark: SparkSession, a: argparse.Namespace) -> None:
    samples = a.samples.split(",") if a.samples else None
    sites = vcf_indexed.vcf(spark, a.vcf, samples) if files.exists(f"{a.vcf}.tbi") else readers.vcf(spark, a.vcf, samples)
    calls = sites.select("chrom", "pos", "ref", "alts", F.explode("gts").alias("g")).select("chrom", "pos", "ref", "alts", "g.sample", "g.a1", "g.a2")
    if a.whole:
        g = readers.fasta(spark, a.reference)
        windows = g.select(F.col("id").alias("doc"), F.col("id").alias("chrom"), F.lit(0).cast("bigint").alias("start"), F.length("seq").cast("bigint").alias("end"), F.upper("seq").alias("seq"))
        writers.variation_corpus(variants.consensus(windows, calls), a.output_dir, a.io_mode)
        return
    if a.reference.endswith(".gz"):
        g = readers.fasta(spark, a.reference).select(F.col("id").alias("chrom"), "seq", F.length("seq").cast("bigint").alias("len"))
        contigs, tiles = g.select("chrom", "len"), intervals.tile(g, haplotypes.TILE)
    else:
        contigs, tiles = fasta_ranges.contigs(spark, a.reference), fasta_ranges.tiles(spark, a.reference, haplotypes.TILE)
    docs = haplotypes.documents(contigs, tiles, calls, "alleles", a.min_density, a.max_n, start=a.start, sentence=tuple(a.sentence), document=tuple(a.document))
    writers.variation_documents(docs, a.output_dir, a.io_mode)


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("strandflow").getOrCreate()
    (build_corpus if a.command == "corpus" else build_alleles)(spark, a)


if __name__ == "__main__":
    main()
