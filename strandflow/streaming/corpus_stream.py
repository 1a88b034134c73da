"""Stateless streaming form of the contig filter and strand expansion: new FASTA files become corpus rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators import corpus


def contigs(spark: SparkSession, folder: str, min_len: int = 10_000, skip: str = "mitochondrion") -> DataFrame:
    """A streaming DataFrame (chrom, seq, len) of both strands of the contigs of files that arrive in folder."""
    raw = spark.readStream.option("lineSep", "\n>").text(folder)
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head = F.split_part(text, F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.substring(text, F.instr(text, "\n") + 1, F.length(text)), r"\s+", "")
    rows = raw.select(head.alias("description"), body.alias("seq")).where(~F.contains("description", F.lit(skip)) & (F.length("seq") >= min_len))
    named = rows.select(F.split_part("description", F.lit(" "), F.lit(1)).alias("chrom"), "seq", F.length("seq").cast("bigint").alias("len"))
    return corpus.both_strands(named)
