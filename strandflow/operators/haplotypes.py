"""Variation corpora: documents of sentences cut from both haplotypes of each sample, on both strands.

Windows are cut from contig lengths alone. Texts are built from tiles, window by window, so no contig is ever one string and a cell is no longer than a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from strandflow.functions import rng, seq, stages

from . import intervals, scan

TILE = 1024
BATCH = 4 << 20  # symbols of documents that leave a task at once
_COMPLEMENT = str.maketrans(seq.IUPAC_FROM, seq.IUPAC_TO)


def windows(contigs: DataFrame, seed: str, start: int = 5000, sentence: tuple[int, int] = (500, 1000), document: tuple[int, int] = (50, 100)) -> DataFrame:
    """(chrom, doc_idx, start, end, lengths): one pass over each contig of (chrom, len) in documents that follow one another without a gap.

    The first starts at a hash draw in [0, start]. A document takes as many sentences as drawn, each of a drawn length, while they end before the contig's last
    base; none starts where the longest sentence would not end before it. So the tail of a contig is left out."""
    lo, hi = sentence
    dlo, dhi = document
    g = contigs.select("chrom", "len", rng.between(0, start, seed, "q", F.col("chrom")).alias("q0")).where(F.col("q0") + hi < F.col("len"))
    g = stages.written(g, "contigs")
    s = g.select("chrom", "len", "q0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("len") - F.col("q0")) / lo))).alias("i"))
    s = s.withColumn("n", rng.between(lo, hi, seed, "s", F.col("chrom"), F.col("i").cast("string")))
    s = scan.prefix(s, {"before": ("sum", F.col("n"))}, scan.whole_bucket(F.col("i"), 4096), (F.col("i"),), ("chrom",), inclusive=False)
    s = s.select("chrom", "len", "i", "n", (F.col("q0") + F.col("before")).alias("s")).where(F.col("s") + F.col("n") < F.col("len"))
    s = stages.written(s, "sentences")
    b = s.groupBy("chrom").agg(F.count("*").alias("m")).select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("m") / dlo))).alias("doc_idx"))
    b = b.withColumn("k", rng.between(dlo, dhi, seed, "d", F.col("chrom"), F.col("doc_idx").cast("string")))
    b = scan.prefix(b, {"low": ("sum", F.col("k"))}, scan.whole_bucket(F.col("doc_idx"), 4096), (F.col("doc_idx"),), ("chrom",), inclusive=False)
    # a document's sentences fall into two bins of sentence numbers at most
    bins = b.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("low") / dhi), F.floor((F.col("low") + F.col("k") - 1) / dhi))))
    j = s.withColumn("_bin", F.floor(F.col("i") / dhi)).join(bins, ["chrom", "_bin"]).where("i >= low and i < low + k")
    d = j.groupBy("chrom", "doc_idx").agg(F.min("s").alias("start"), F.max(F.col("s") + F.col("n")).alias("end"), F.first("len").alias("len"), F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("lengths"))
    return d.where(F.col("start") + hi < F.col("len")).drop("len")


def alleles_in(text: str, sites: list[tuple[int, str]], calls: dict[tuple[int, str], tuple[str, str]]) -> tuple[str, str]:
    """Both haplotypes of a window: at each site (place, reference) the alleles that calls has, else the reference. In order of place, then length, a site that starts before
    the end of the one applied before it is left out."""
    first, second, done = [], [], 0
    for lp, ref in sorted(sites, key=lambda x: (x[0], len(x[1]), x[1])):
        if lp >= done:
            a, b = calls.get((lp, ref), (ref, ref))
            between = text[done:lp]
            first += (between, a)
            second += (between, b)
            done = lp + len(ref)
    return "".join([*first, text[done:]]), "".join([*second, text[done:]])


def cut(text: str, lengths: list[int]) -> list[str]:
    """Sentences of the given lengths, in order; where the text ends they are shorter or empty."""
    out, at = [], 0
    for n in lengths:
        out.append(text[at : at + n])
        at += n
    return out


def documents(contigs: DataFrame, tiles: DataFrame, calls: DataFrame, seed: str, min_density: float = 0.01, max_n: float = 0.5, both: bool = True, width: int = TILE, **options) -> DataFrame:
    """(chrom, doc_idx, sample, haplotype, strand, text, vcs, len, snt): the documents of `windows` with each sample's alleles in them.

    contigs: (chrom, len); tiles: the genome in tiles of `width`; calls: (chrom, pos, ref, alts, sample, a1, a2) with 1-based places and -1 for a missing allele. A site counts in the
    window that holds its base; one that starts before the end of the one applied before it is left out. Where the first allele is missing, or a sample has no call, both alleles are the reference.

    Windows with more than `max_n` of N or without sites have no documents, nor have samples without a non-reference first allele in the window or with fewer genotyped sites
    than `min_density` a base. The second haplotype is there where it differs. Sentence lengths are those of the window, so a longer haplotype is cut short and a shorter one has short last
    sentences; the other strand's sentences follow the lengths from the last to the first. vcs counts genotyped sites, len is the window's, snt its number of sentences."""
    w = intervals.get_fasta(stages.written(windows(contigs, seed, **options), "windows"), tiles, width)
    w = w.withColumn("sequence", F.upper("sequence")).where(seq.count_of(F.col("sequence"), "N") <= (F.col("end") - F.col("start")) * max_n)
    w = stages.written(w, "texts")
    at = calls.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "ref", "alts", "sample", "a1", "a2")
    met = intervals.overlap_join(w.select("chrom", "doc_idx", "start", "end"), at)
    met = stages.written(met.select("chrom", "doc_idx", "sample_b", (F.col("start_b") - F.col("start")).alias("lp"), "ref_b", "alts_b", "a1_b", "a2_b").toDF("chrom", "doc_idx", "sample", "lp", "ref", "alts", "a1", "a2"), "calls")
    missing = F.coalesce(F.col("a1"), F.lit(-1)) == -1
    alleles = [F.when(missing, F.col("ref")).otherwise(seq.allele(F.col("ref"), F.col("alts"), F.col(c))).alias(x) for c, x in (("a1", "x1"), ("a2", "x2"))]
    # a window's sites are all samples'; each sample's own calls decide whether it is used
    sites = met.select("chrom", "doc_idx", "lp", "ref").distinct().groupBy("chrom", "doc_idx").agg(F.collect_list(F.struct("lp", "ref")).alias("sites"))
    use = met.groupBy("chrom", "doc_idx", "sample").agg(F.count_if(~missing).alias("vcs"), F.bool_or(F.coalesce(F.col("a1") > 0, F.lit(False))).alias("used"), F.collect_list(F.struct("lp", "ref", *alleles)).alias("calls"))
    size = F.col("end") - F.col("start")
    use = use.where("used").join(sites, ["chrom", "doc_idx"]).join(w, ["chrom", "doc_idx"]).where(F.col("vcs") >= size * min_density)
    given = use.select("chrom", "doc_idx", "sample", "vcs", size.alias("len"), "lengths", "sequence", "sites.lp", "sites.ref", *(F.col(f"calls.{x}").alias(f"own_{x}") for x in ("lp", "ref", "x1", "x2")))
    kinds = given.schema
    schema = StructType([kinds["chrom"], kinds["doc_idx"], kinds["sample"], StructField("haplotype", IntegerType()), StructField("strand", StringType()), StructField("text", ArrayType(StringType())), StructField("vcs", LongType()), kinds["len"], StructField("snt", IntegerType())])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            own = pa.array([r[0] for r in rows])
            haplotype, strand, text, snt = (pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.list_(pa.string())), (4, pa.int32())))
            c = {n: batch.column(n).take(own) for n in ("chrom", "doc_idx", "sample", "vcs", "len")}
            return pa.RecordBatch.from_arrays([c["chrom"], c["doc_idx"], c["sample"], haplotype, strand, text, c["vcs"], c["len"], snt], names=schema.names)

        for batch in batches:
            rows, held = [], 0
            for a in range(0, batch.num_rows, 64):
                part = [batch.column(k).slice(a, 64).to_pylist() for k in range(5, batch.num_columns)]
                for k, (lengths, text, lp, ref, own_lp, own_ref, x1, x2) in enumerate(zip(*part, strict=True), a):
                    one, two = alleles_in(text, list(zip(lp, ref, strict=True)), dict(zip(zip(own_lp, own_ref, strict=True), zip(x1, x2, strict=True), strict=True)))
                    for h, s in enumerate((one,) if one == two else (one, two), 1):
                        rows.append((k, h, "+", cut(s, lengths), len(lengths)))
                        if both:
                            rows.append((k, h, "-", cut(s.translate(_COMPLEMENT)[::-1], lengths[::-1]), len(lengths)))
                        held += 2 * len(s)
                    if held > BATCH:
                        yield sent()
                        rows, held = [], 0
            if rows:
                yield sent()

    return given.mapInArrow(written, schema)
