"""Invariants: involutions, partitions of the line, naive against binned joins, budgets."""

import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions import bpe, inference, seq
from strandflow.operators import corpus, datasets, intervals, tokens
from strandflow.plans import proxies, registry


def random_intervals(n, seed, top=3000):
    r = random.Random(seed)
    return [(f"c{r.randrange(3)}", s := r.randrange(top), s + r.choice([1, 5, 40, 900]), str(k)) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, end long, name string")


def test_reverse_complement_twice(spark):
    df = spark.createDataFrame([("ACGTN",), ("",), (None,), ("acgtRYKM",)], "s string")
    assert df.where(~F.col("s").eqNullSafe(seq.revcomp_iupac(seq.revcomp_iupac(F.col("s"))))).count() == 0


def test_binned_join_equals_naive(spark):
    a, b = random_intervals(120, 1), random_intervals(120, 2)
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    for width in (64, 1 << 14):
        got = sorted((r.name, r.name_b) for r in intervals.overlap_join(frame(spark, a), frame(spark, b), width).collect())
        assert got == want
    anti = {r.name for r in intervals.overlap_join(frame(spark, a), frame(spark, b), how="left_anti").collect()}
    assert anti == {x[3] for x in a} - {x for x, _ in want}


def test_merge_and_complement_partition_the_contigs(spark):
    a = random_intervals(80, 3)
    sizes = spark.createDataFrame([(f"c{k}", 5000) for k in range(4)], "chrom string, len long")
    m = [tuple(r) for r in intervals.merge(frame(spark, a)).select("chrom", "start", "end").collect()]
    c = [tuple(r) for r in intervals.complement(frame(spark, a), sizes).collect()]
    for k in range(4):
        line = sorted((s, e) for x, s, e in m + c if x == f"c{k}")
        assert line[0][0] == 0 and line[-1][1] == 5000 and all(p[1] == q[0] for p, q in zip(line, line[1:]))


def test_merge_over_stretches(spark, monkeypatch):
    a = random_intervals(80, 4)
    whole = {tuple(r) for r in intervals.merge(frame(spark, a), 7).collect()}
    monkeypatch.setattr(intervals, "STRETCH", 100)
    assert {tuple(r) for r in intervals.merge(frame(spark, a), 7).collect()} == whole


def test_corpus_sentences_rebuild_the_contig(spark):
    r = random.Random(5)
    g = [(f"c{k}", "".join(r.choice("ACGT") for _ in range(n))) for k, n in enumerate((0, 10, 700, 5000))]
    df = spark.createDataFrame([(c, s, len(s)) for c, s in g], "chrom string, seq string, len long")
    got = {}
    for row in corpus.documents(df, "s", start=50, sentence=(50, 100), document=(5, 10)).orderBy("chrom", "doc_idx").collect():
        got[row.chrom] = got.get(row.chrom, "") + "".join(row.text)
    for c, s in g:
        assert s.endswith(got.get(c, "")) and len(s) - len(got.get(c, "")) <= max(50, len(s) if c not in got else 0)


def test_balanced_length_is_constant(spark):
    rows = [(list(range(5, 5 + a)), list(range(5, 5 + m)), list(range(5, 5 + b))) for a in (0, 1, 7, 30) for m in (0, 3, 16, 17, 40) for b in (0, 2, 9, 30)]
    df = spark.createDataFrame(rows, "l array<int>, m array<int>, r array<int>")
    left, mid, right, pads = tokens.balance(F.col("l"), F.col("m"), F.col("r"), 20, 4)
    assert df.where(F.size(left) + F.size(mid) + F.size(right) + pads + 4 != 20).count() == 0


def test_bpe(spark):
    df = spark.createDataFrame([("ACACACGT" * 5,), ("GTGTACAC" * 3,)], "s string")
    b = bpe.train(df, "s", 6)
    ids, starts, ends = b.encode("ACACGTX")
    assert starts[0] == 0 and ends[-1] == 7 and ids[-1] == 0 and len(ids) < 7
    assert "".join(b.pieces("ACACGTX")) == "ACACGTX"
    assert len(b.pieces("ACACGT", 1.0)) == 6
    got = df.select(b.column(F.col("s")).alias("e")).select("e.ids").first().ids
    assert got == b.encode("ACACACGT" * 5)[0]


def test_inference_plugin(spark):
    df = spark.createDataFrame([("AACC",), ("",)], "s string")
    assert [r.value for r in inference.apply(df, "strandflow.functions.inference:composition", "s").collect()] == [[0.5, 0.5, 0.0, 0.0], [0.0] * 4]


def test_stream(spark, tmp_path):
    from strandflow.streaming import corpus_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">a\n" + "ACGT" * 10 + "\n>m mitochondrion\n" + "ACGT" * 10 + "\n>s\nAC\n")
    q = corpus_stream.contigs(spark, str(tmp_path / "in"), 20).writeStream.format("memory").queryName("stream_contigs").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.chrom for r in spark.sql("select chrom from stream_contigs").collect()) == ["a", "rc_a"]


def test_two_decimals_as_python_writes_them(spark):
    values = [k / 8 for k in range(-50, 51)] + [1.005, 1.015, 2.675, 1e16, 0.0, -0.001, 12345678.125, None]
    got = spark.createDataFrame(list(enumerate(values)), "k int, x double").select("k", seq.two_decimals(F.col("x")).alias("t")).collect()
    assert {r.k: r.t for r in got} == {k: None if x is None else f"{x:.2f}" for k, x in enumerate(values)}


def test_relative_bucket_edges(spark):
    df = spark.range(-300, 301).select("id", seq.relative_bucket(F.col("id")).alias("b"))
    got = {r.id: r.b for r in df.collect()}
    # the reference's edges: 8 + 8 log(n / 8) / log(16), at most 15
    assert [got[-n] for n in (15, 16, 31, 32, 63, 64, 127, 128, 300)] == [9, 10, 11, 12, 13, 14, 15, 15, 15]
    assert all(got[n] == 16 + got[-n] for n in range(1, 301)) and got[0] == 0
    # n is in far bucket k from n^8 * 8^k >= 8^8 * 128^k on
    assert all(got[-n] == max(8 + k for k in range(8) if n**8 * 8**k >= 8**8 * 128**k) for n in range(8, 301))


def test_promoters_keep_every_document_up_to_16000_letters(spark, data):
    got = registry.QUERIES["g06_promoter_dataset"](spark, data).collect()
    want = {r.chrom: r.seq[: min(16_000, r.len // 20 * 20)] for r in proxies.genome(spark, data).collect()}
    assert {r.name: r.sequence for r in got if r.promoter_presence} == want
    assert len(got) == 2 * len(want) and any(len(x) > 400 for x in want.values())
    assert all(sorted(r.sequence) == sorted(want[r.name]) for r in got)


def test_promoters_that_do_not_divide_raise(spark):
    df = spark.createDataFrame([("a", "ACGT" * 10), ("b", "ACG" * 7)], "name string, sequence string")
    with pytest.raises(Exception, match="must divide into the blocks"):
        datasets.promoter_dataset(df, 400, "x").collect()
