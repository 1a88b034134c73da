"""What keeps queries in proportion to their tables: plans and memory."""

import hashlib

import pytest

import __spark_entry__
from strandflow.operators import intervals, tokens, variants
from strandflow.plans import proxies

SMALL = "/root/testdata/sf0.001"


def plan(spark, name):
    return __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["g02_genome_corpus", "g03_consensus", "g03_documents", "g05_holdout", "g07_peak_dataset", "g08_peak_regression", "g10_variant_sequences_all"])
def test_letters_are_translated_once(spark, name, monkeypatch):
    calls, genome = [], proxies.genome
    monkeypatch.setattr(proxies, "genome", lambda *a: calls.append(a) or genome(*a))
    assert "bases(" not in plan(spark, name) and len(calls) == 1


def test_haplotypes_are_compared_where_they_are_built(spark):
    assert "Window" not in plan(spark, "g03_consensus")


def test_token_places_need_no_window(spark):
    assert "Window" not in plan(spark, "t14_token_mean_label")
    df = spark.createDataFrame([(1, [5, 7, 1]), (2, []), (3, None), (4, [2])], "id int, a array<int>")
    assert {r.id: r.s for r in df.select("id", tokens.starts("a").alias("s")).collect()} == {1: [0, 5, 12], 2: [], 3: None, 4: [0]}


def test_mutants_are_digested_in_one_pass(spark):
    assert "Generate" not in plan(spark, "t24_mutagenesis")
    got = variants.mutant_digests(spark.createDataFrame([(1, "ACG"), (2, "\u00e4T"), (3, None)], "id int, s string"), "s", [0, 2])
    want = {(1, 0, x, x + "CG") for x in "CGT"} | {(1, 2, x, "AC" + x) for x in "ACT"} | {(2, 0, x, x + "T") for x in "ACGT"}
    assert sorted(map(tuple, got.collect())) == sorted((k, p, x, hashlib.md5(t.encode()).hexdigest()) for k, p, x, t in want)


def test_tiles_of_plain_and_other_symbols(spark):
    rows = [("a", "ACGTACGTAC", 10), ("b", "", 0), ("c", None, None), ("d", "\u00e4C\U0001f9ecGT", 5), ("e", "ACGT", 4)]
    got = sorted(tuple(r) for r in intervals.tile(spark.createDataFrame(rows, "chrom string, seq string, len long").coalesce(1), 4).collect())
    assert got == [("a", 0, "ACGT", 10), ("a", 1, "ACGT", 10), ("a", 2, "AC", 10), ("d", 0, "\u00e4C\U0001f9ecG", 5), ("d", 1, "T", 5), ("e", 0, "ACGT", 4)]


def test_intervals_in_one_tile_and_in_several(spark):
    tiles = intervals.tile(spark.createDataFrame([("a", "ACGTTGCAAC", 10)], "chrom string, seq string, len long"), 4)
    rows = [("a", 1, 3, "x"), ("a", 1, 3, "x"), ("a", 2, 9, "y"), ("a", 2, 9, "y"), ("a", 9, 30, "z"), ("a", 5, 5, "none"), ("b", 0, 2, "none")]
    got = intervals.get_fasta(spark.createDataFrame(rows, "chrom string, start long, end long, name string"), tiles, 4)
    assert sorted((r.name, r.sequence) for r in got.collect()) == [("x", "CG"), ("x", "CG"), ("y", "GTTGCAA"), ("y", "GTTGCAA"), ("z", "C")]


def test_span_means_shuffle_each_side_once(spark):
    """Spans inside a bin, repeated ones, one that crosses bins, an empty one."""
    edge = intervals.BIN
    spans = spark.createDataFrame([("c", 0, 10, "a"), ("c", 0, 10, "a"), ("c", edge - 5, edge + 5, "b"), ("c", 7, 7, "e")], "chrom string, start long, end long, name string")
    signal = spark.createDataFrame([("c", 5, 7, 2.0), ("c", edge - 1, edge + 1, 5.0)], "chrom string, start long, end long, value double")
    got = sorted(((r.name, r["mean"]) for r in intervals.span_mean(spans, signal).collect()), key=str)
    assert got == [("a", 0.4), ("a", 0.4), ("b", 1.0), ("e", None)]


@pytest.mark.parametrize("name", ["t04_bpe_dropout", "t24_mutagenesis"])
def test_tiles_are_translated_and_cut_in_one_pass(spark, name, tmp_path):
    """A filter on the translated text evaluated it twice, in workers of their own."""
    assert "bases(" not in plan(spark, name)
    rows = [(1, "The quick brown fox. " * 40), (2, None), (3, ""), (4, "12 äö"), (5, "AbäC")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = (sorted(map(tuple, df.collect())) for df in (proxies.tiles(spark, str(tmp_path)), intervals.tile(proxies.genome(spark, str(tmp_path)))))
    assert got == want and len(got) == 4
