"""Training of byte pairs, numbered records, metadata, command lines and small sources and sinks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow import cli
from strandflow.functions import bpe
from strandflow.operators import intervals
from strandflow.plans import proxies
from strandflow.sources import readers, records, writers


def naive_bpe(texts, merges, piece):
    pieces = [list(t[k : k + piece]) for t in texts for k in range(0, len(t), piece)]
    out = []
    while len(out) < merges:
        n = {}
        for p in pieces:
            k = 0
            while k < len(p) - 1:
                pair = (p[k], p[k + 1])
                n[pair] = n.get(pair, 0) + 1
                # of a run of one symbol every other pair counts
                k += 2 if p[k] == p[k + 1] and k + 2 < len(p) and p[k + 2] == p[k] else 1
        n = {k: x for k, x in n.items() if x > 1}
        if not n:
            break
        best = min(n, key=lambda k: (-n[k], k))
        out.append(best)
        for p in pieces:
            k = 0
            while k < len(p) - 1:
                if (p[k], p[k + 1]) == best:
                    p[k : k + 2] = [p[k] + p[k + 1]]
                k += 1
    return out


@pytest.mark.parametrize("rewrite", [2, 16])
def test_bpe_training_brute_force(spark, rewrite):
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("ACGT."), n, p=[0.4, 0.2, 0.2, 0.1, 0.1])) for n in r.integers(0, 300, 25)] + ["AAAAAAA", "", "A"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "s string")
    got = bpe.train(df, "s", 60, piece=64, rewrite=rewrite)
    assert sorted(got.ranks, key=got.ranks.get) == naive_bpe(texts, 60, 64)
    assert bpe.train(df.limit(0), "s", 5).ranks == {}


def test_registered_training_brute_force(spark, data):
    from strandflow.plans import registry

    texts = [r.seq for r in proxies.genome(spark, data).collect()]
    got = registry.QUERIES["t01_bpe_train"](spark, data).orderBy("rank").collect()
    # whole sequences, so no pair is lost at a cut
    assert [(r.first, r.second) for r in got] == naive_bpe(texts, 12, max(map(len, texts)))


def test_bpe_training_takes_ties_by_text(spark):
    """Every pair occurs twice, so all are tied: the first by text comes next, beyond what a round looks at too."""
    letters = [chr(0x100 + k) for k in range(600)]
    texts = ["".join(letters)] * 2
    df = spark.createDataFrame([(t,) for t in texts], "s string").repartition(2)
    assert sorted((r := bpe.train(df, "s", 6, batch=4)).ranks, key=r.ranks.get) == naive_bpe(texts, 6, 1000)


def test_records(spark, tmp_path):
    df = spark.createDataFrame([(k * 7 % 101, f"x{k}") for k in range(101)], "key long, name string").repartition(5)
    r = records.number_rows(df, f"file://{tmp_path}/r", "key")
    assert len(r) == 101 and r[3].key == 3 and r[-1].key == 100 and [x.key for x in r[5:9]] == [5, 6, 7, 8]
    assert [x.key for x in r] == list(range(101)) and r.shard(2, 10).count() == 10
    with pytest.raises(IndexError):
        r[101]
    assert len(records.number_rows(df.limit(0), f"file://{tmp_path}/e", "key")) == 0
    assert records.apply_groups(df, ("key",), lambda g: g[["key"]].head(1), "key long").count() == 101
    assert records.apply_rows(df, lambda g: g[["key"]] * 2, "key long").agg(F.max("key")).first()[0] == 200


def test_metadata_and_small_sources(spark, tmp_path):
    (tmp_path / "statistics.json").write_text(json.dumps({"num_targets": 5313, "seq_length": 131072, "train_seqs": 3}, indent=2))
    m = readers.metadata(spark, f"{tmp_path}/statistics.json").first()
    assert (m.num_targets, m.seq_length, m.train_seqs) == (5313, 131072, 3)
    (tmp_path / "s.bed").write_text("chr1\t1\t5\ttrain\nchr2\t3\t9\ttest\n")
    assert {tuple(r) for r in readers.split_bed(spark, f"{tmp_path}/s.bed").collect()} == {("chr1", 1, 5, "train"), ("chr2", 3, 9, "test")}
    (tmp_path / "a.fa").write_text(">c1\nACGT\n")
    (tmp_path / "b.fa").write_text(">c2\nGG\n>c3\nT\n")
    meta = spark.createDataFrame([("A", "http://x/a.fa"), ("B/", "http://x/b.fa")], "name string, file string")
    assert {(r.species, r.id, r.seq) for r in readers.species_files(spark, meta, str(tmp_path)).collect()} == {("A", "c1", "ACGT"), ("B", "c2", "GG"), ("B", "c3", "T")}
    n = spark.createDataFrame([("p-2.tfr",), ("p-10.tfr",), ("none",)], "f string")
    assert [r.f for r in n.orderBy(readers.numeric_suffix(F.col("f"))).collect()] == ["none", "p-2.tfr", "p-10.tfr"]
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "row int, a string"), spark.createDataFrame([(1, "v"), (0, "u")], "row int, b string")
    assert {tuple(r) for r in readers.zip_rows(a, b).select("a", "b").collect()} == {("x", "u"), ("y", "v")}
    with pytest.raises(ValueError):
        readers.zip_rows(a, b.limit(1))
    writers.folds(spark.createDataFrame([(0, "train", "q"), (1, "test", "r")], "split int, role string, v string"), f"{tmp_path}/folds")
    assert spark.read.option("header", True).csv(f"{tmp_path}/folds/split=1/role=test").first().v == "r"


def test_fetch_regions(spark):
    g = spark.createDataFrame([("c:1", "ACGTNACGTA" * 60, 600)], "chrom string, seq string, len long")
    q = spark.createDataFrame([("c:1:1-5",), ("c:1:250-262",), ("c:1:600",), ("zz:1-2",), ("bad",)], "region string")
    got = {r.region: r.sequence for r in intervals.fetch_regions(q, intervals.tile(g)).collect()}
    s = "ACGTNACGTA" * 60
    assert got == {"c:1:1-5": s[:5], "c:1:250-262": s[249:262], "c:1:600": s[599]}


def test_a_long_contig_in_one_pass(spark):
    g = spark.range(1).select(F.lit("c").alias("chrom"), F.expr("repeat('ACGTACGTAC', 5000000)").alias("seq"), F.lit(50_000_000).cast("bigint").alias("len"))
    t = intervals.tile(g, 1024).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bp"), F.max("tile_idx").alias("last")).first()
    assert tuple(t) == (48829, 50_000_000, 48828)


def test_command_lines(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 x\n" + "ACGTNACGTA" * 3000 + "\n>short\nACGT\n")
    cli.main(["corpus", "--input-file", f"{tmp_path}/g.fa", "--output-dir", f"{tmp_path}/c", "--io-mode", "jsonl", "--n_augmentations", "2"])
    d = spark.read.json(f"{tmp_path}/c")
    assert {r.chrom for r in d.select("chrom").distinct().collect()} == {"c1", "rc_c1"} and d.where("doc_idx like '1_%'").count() > 0
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nshort\t2\t.\tC\tT\t.\t.\t.\tGT\t1|0\t0|0\n")
    cli.main(["alleles", "--reference", f"{tmp_path}/g.fa", "--vcf", f"{tmp_path}/v.vcf", "--output-dir", f"{tmp_path}/a", "--whole"])
    got = {(r.sample, r.haplotype, r.strand): r.text for r in spark.read.json(f"{tmp_path}/a").collect()}
    assert got == {("S1", 1, "+"): ["ATGT"], ("S1", 1, "-"): ["ACAT"], ("S1", 2, "+"): ["ACGT"], ("S1", 2, "-"): ["ACGT"]}
    with pytest.raises(SystemExit):
        cli.main(["corpus"])


def test_dropout_drops_some_merges(spark):
    from strandflow.plans import q_models

    m = q_models.model()
    texts = ["".join(np.random.default_rng(k).choice(list("ACGTN"), 200)) for k in range(50)]
    whole, some, none = ([m.pieces(t, p, f"s|{t}") for t in texts] for p in (0.0, 0.1, 1.0))
    assert all("".join(p) == t for x in (whole, some, none) for p, t in zip(x, texts, strict=True)) and none == [list(t) for t in texts]
    n = [sum(map(len, x)) for x in (whole, some)]
    assert n[0] < n[1] < 1.3 * n[0] and sum(a != b for a, b in zip(whole, some, strict=True)) > 40
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(m.column(F.col("t"), 0.1, "s")["ids"].alias("ids")).collect()
    assert [r.ids for r in got] == [[m.vocabulary[x] for x in p] for p in some]


def test_predictions_of_a_part_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id int, p double")
    for part in ("a", "b", "a"):
        writers.append_predictions(df, f"{tmp_path}/p", part)
    assert sorted((r.part, r.id) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    for uri in (f"{tmp_path}/m.json", f"file://{tmp_path}/m.json"):
        writers.merge_metrics(uri, uri[:4], {"f1": 0.5})
    assert set(writers.merge_metrics(f"{tmp_path}/m.json", "x", {"f1": 1})) == {uri[:4] for uri in (f"{tmp_path}/m.json", "file")} | {"x"}
