import gzip
import json

from pyspark.sql import functions as F

from strandflow.sources import readers as R
from strandflow.sources import writers as W


def write(tmp_path, name, text):
    p = tmp_path / name
    (gzip.open(p, "wt") if name.endswith(".gz") else open(p, "w", newline="")).write(text)
    return str(p)


def test_fasta(spark, tmp_path):
    text = ">a first contig\r\nACgt\r\nNN\r\n>b mitochondrion\nAC\n>empty\n>c\nTT\nGG\n"
    want = [("a", "ACgtNN"), ("b", "AC"), ("c", "TTGG"), ("empty", "")]
    for name in ("x.fa", "x.fa.gz"):
        got = sorted((r.id, r.seq) for r in R.fasta(spark, write(tmp_path, name, text)).collect())
        assert got == want


def test_two_line_fasta_stops_at_blank_line(spark, tmp_path):
    p = write(tmp_path, "x.fa", ">h1\nAC\n>h2\nGT\n\n>h3\nTT\n")
    assert [(r.row, r.header, r.seq) for r in R.fasta_two_line(spark, p).orderBy("row").collect()] == [(0, "h1", "AC"), (1, "h2", "GT")]
    assert R.raw_fasta_text(spark, p, 4) == "ACGT"


def test_bed(spark, tmp_path):
    p = write(tmp_path, "x.bed", "# c\nchr1\t5\t9\tp\t0\t+\t1\t2\t3\t4\nchr1\t7\t8\nshort\t1\n\nchr2\t1\t4\tq\t0\t-\t1\t2\t3\tnone\n")
    assert sorted((r.chrom, r.start, r.end, r.summit) for r in R.bed(spark, p).collect()) == [("chr1", 5, 9, 4), ("chr1", 7, 8, None), ("chr2", 1, 4, None)]


def test_gtf(spark, tmp_path):
    from strandflow.functions import seq

    p = write(tmp_path, "x.gtf", '#!x\nchr1\ths\texon\t11\t20\t.\t+\t.\tgene_id "g1"; tag "basic"; tag "CCDS";\n')
    r = R.gtf(spark, p).select("start", "end", seq.gtf_tags(F.col("attributes")).alias("tags"), seq.gtf_attribute(F.col("attributes"), "gene_id").alias("g")).first()
    assert (r.start, r.end, r.tags, r.g) == (10, 20, ["basic", "CCDS"], "g1")


def test_vcf(spark, tmp_path):
    p = write(tmp_path, "x.vcf", "##h\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t7\tv1\tA\tC,G\t.\t.\tK=1;F;K=2\tGT:X\t0|2:1\t./.\nchr1\t90\tv2\tA\tC\t.\t.\t.\tGT\t1/1\t0/1\n")
    r = R.vcf(spark, p, ["s2", "s1"], ("chr1", 6, 7)).collect()
    assert len(r) == 1 and r[0].info == {"K": "2", "F": "true"} and r[0].alts == ["C", "G"]
    assert [(g.sample, g.a1, g.a2, g.phased) for g in r[0].gts] == [("s2", -1, -1, False), ("s1", 0, 2, True)]


def test_small_text_readers(spark, tmp_path):
    assert R.wide_csv(spark, write(tmp_path, "w.csv", "ACGT,0,1,2\n")).first().targets == [0, 1, 2]
    assert sorted(tuple(r) for r in R.contig_breaks(spark, write(tmp_path, "c.csv", 'name,intervals\nc1,"[(0, 5), (7, 9)]"\nc2,"[]"\n')).collect()) == [("c1", 0, 5), ("c1", 7, 9)]
    assert tuple(R.mapping(spark, write(tmp_path, "m.txt", "a;b;benign\n")).first()) == ("a;b", "benign")
    assert R.line_set(spark, write(tmp_path, "g.txt", " G1 \nG1\n\n")).count() == 1
    blocks = R.aligner_blocks(spark, write(tmp_path, "a.txt", "SQ 1\nEM  chr8:+5\n//\nSQ 2\n//\n"))
    assert [(r.row, r.hits) for r in blocks.orderBy("row").collect()] == [(0, "chr8:+5"), (1, None)]


def test_required_columns(spark, tmp_path):
    import pytest

    p = write(tmp_path, "r.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError):
        R.csv_union(spark, p, ("c",))
    assert R.csv_union(spark, [p], ("a",)).count() == 1


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([("c1", 0, ["AC", "GT"]), ("c2", 1, ["TT"])], "chrom string, doc_idx int, text array<string>")
    W.single_txt(docs, str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t/chrom=c1")).collect()) == ["AC", "GT"]
    W.jsonl(docs, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    W.multiple_txt(docs, str(tmp_path / "m"))
    assert (tmp_path / "m/document=c2_document_1").exists()
    W.fasta(docs.select(F.col("chrom").alias("name"), F.array_join("text", "").alias("sequence")), str(tmp_path / "f"))
    assert sorted((r.id, r.seq) for r in R.fasta(spark, str(tmp_path / "f")).collect()) == [("c1", "ACGT"), ("c2", "TT")]
    W.delimited(docs.select("chrom"), str(tmp_path / "d"), "\t", False, "gzip")
    assert spark.read.csv(str(tmp_path / "d")).count() == 2
    W.append_predictions(docs, str(tmp_path / "p"))
    W.append_predictions(docs, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    m = str(tmp_path / "metrics.json")
    W.merge_metrics(m, "a", {"x": 1})
    assert W.merge_metrics(m, "b", {"y": 2}) == {"a": {"x": 1}, "b": {"y": 2}} == json.load(open(m))
