"""Sinks for corpora, datasets and metrics, on Spark's own writers."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import seq

from . import files


def single_txt(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder for each chromosome, a line for each sentence."""
    docs.select("chrom", F.explode("text").alias("value")).write.mode(mode).partitionBy("chrom").text(path)


def jsonl(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON document a line: text and whatever other columns there are; chromosomes are folders."""
    docs.write.mode(mode).partitionBy("chrom").json(path)


def multiple_txt(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder for each document, {chrom}_document_{doc_idx}: for small corpora only."""
    name = F.concat("chrom", F.lit("_document_"), F.col("doc_idx").cast("string"))
    docs.select(name.alias("document"), F.array_join("text", "\n").alias("value")).write.mode(mode).partitionBy("document").text(path)


MODES = {"single_txt": single_txt, "jsonl": jsonl, "multiple_txt": multiple_txt}


def variation_corpus(haplotypes: DataFrame, path: str, mode: str = "jsonl", both: bool = True) -> None:
    """Haplotypes (doc, sample, haplotype, seq) as a corpus, a document each, and with `both` its reverse complement beside it.

    single_txt and multiple_txt have a folder for each sample (chrom=<sample>); jsonl keeps doc, sample, haplotype and strand beside the text."""
    strands = [F.struct(F.lit("+").alias("strand"), F.col("seq").alias("s"))]
    if both:
        strands.append(F.struct(F.lit("-").alias("strand"), seq.revcomp_iupac(F.col("seq")).alias("s")))
    x = haplotypes.select(F.col("sample").alias("chrom"), "doc", "sample", "haplotype", F.explode(F.array(*strands)).alias("x"))
    x = x.select("chrom", "doc", "sample", "haplotype", "x.strand", F.concat_ws("_", F.col("doc").cast("string"), F.col("haplotype").cast("string"), F.when(F.col("x.strand") == "+", "fw").otherwise("rc")).alias("doc_idx"), F.array("x.s").alias("text"))
    MODES[mode](x if mode == "jsonl" else x.select("chrom", "doc_idx", "text"), path)


def variation_documents(docs: DataFrame, path: str, mode: str = "jsonl") -> None:
    """Documents of haplotypes.documents: jsonl keeps everything beside the sentences, with VF the genotyped sites a base in two decimals; the text modes have a line a
    sentence. Chromosomes are folders, a document's name holds its sample, haplotype and strand."""
    name = F.concat_ws("_", "sample", F.col("doc_idx").cast("string"), F.col("haplotype").cast("string"), F.when(F.col("strand") == "+", "fw").otherwise("rc"))
    if mode == "jsonl":
        jsonl(docs.withColumn("VF", F.format_number(F.col("vcs") / F.col("len"), 2)), path)
    else:
        MODES[mode](docs.select("chrom", name.alias("doc_idx"), "text"), path)


def delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, compression: str | None = None, mode: str = "overwrite") -> None:
    """CSV or TSV, optionally gzipped, columns in the order of df."""
    w = df.write.mode(mode).option("header", header).option("sep", sep)
    (w.option("compression", compression) if compression else w).csv(path)


def fasta(df: DataFrame, path: str, compression: str | None = "gzip", mode: str = "overwrite") -> None:
    """Records of (name, sequence) in two lines each."""
    w = df.select(F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value")).write.mode(mode)
    (w.option("compression", compression) if compression else w).text(path)


def folds(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows of (split, role, ...) under split=i/role=train."""
    df.write.mode(mode).partitionBy("split", "role").option("header", True).csv(path)


def append_predictions(df: DataFrame, path: str, part: str | None = None) -> None:
    """Adds rows to a store of predictions. Rows of a named part take the place of that part's earlier rows, so a job that is run again adds nothing twice."""
    if part is None:
        df.write.mode("append").parquet(path)
    else:
        df.withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def merge_metrics(path: str, key: str, values: Mapping[str, float]) -> dict:
    """Sets one key of a JSON file, at a local path or in a store, that one driver keeps, and returns the whole. The file is replaced at once, so readers see it before or after."""
    known = json.loads(files.read_all(path)) if files.exists(path) else {}
    known[key] = dict(values)
    store, own = files.opened(path)
    with store.open_output_stream(f"{own}.new") as f:
        f.write(json.dumps(known, indent=1, sort_keys=True).encode())
    store.move(f"{own}.new", own)
    return known
