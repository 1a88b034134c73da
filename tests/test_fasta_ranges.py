"""FASTA by byte ranges: the index and tiles against the plain reader, whatever the ranges."""

import random

import pytest
from pyspark.sql import functions as F

from strandflow.operators import intervals
from strandflow.sources import fasta_ranges as X
from strandflow.sources import readers


def wrapped(seq, width, end):
    return "".join(seq[k : k + width] + end for k in range(0, len(seq), width))


def records(rng):
    return {f"c{k}": "".join(rng.choices("ACGTNacgt", k=n)) for k, n in enumerate([0, 1, 59, 60, 61, 120, 1000, 3333, 7])}


@pytest.mark.parametrize("end,width,chunk,last", [("\n", 60, 1 << 20, True), ("\n", 60, 97, True), ("\r\n", 60, 64, True), ("\n", 5000, 41, False), ("\n", 7, 13, False), ("\r\n", 61, 50, False)])
def test_index_and_tiles(spark, tmp_path, end, width, chunk, last):
    given = records(random.Random(width))
    text = "".join(f">{n} some words{end}" + wrapped(s, width, end) for n, s in given.items())
    path = str(tmp_path / "x.fa")
    open(path, "w", newline="").write(text if last else text.rstrip("\r\n"))
    got = {r.name: r for r in X.index(spark, path, chunk).collect()}
    assert {n: r.length for n, r in got.items()} == {n: len(s) for n, s in given.items()}
    assert all(got[n].offset == text.index(f">{n} ") + len(f">{n} some words{end}") for n in given)
    t = X.tiles(spark, path, 16, chunk)
    assert {(r.chrom, r.tile_idx): (r.seq, r.len) for r in t.collect()} == {(n, k): (s[16 * k : 16 * k + 16], len(s)) for n, s in given.items() for k in range(-(-len(s) // 16))}
    plain = readers.fasta(spark, path).select(F.col("id").alias("chrom"), "seq", F.length("seq").cast("bigint").alias("len"))
    want = intervals.tile(plain, 16)
    assert sorted(map(tuple, want.select("chrom", "tile_idx", "seq", "len").collect())) == sorted(map(tuple, t.select("chrom", "tile_idx", "seq", "len").collect()))
    assert {(r.chrom, r.len) for r in X.contigs(spark, path).collect()} == {(n, len(s)) for n, s in given.items()}


def test_a_record_is_many_tasks(spark, tmp_path):
    """30 million bases in lines of 60: over 50 tasks, no cell above a tile."""
    path = str(tmp_path / "big.fa")
    line = "ACGTTGCAAC" * 6 + "\n"
    with open(path, "w") as f:
        f.write(">one\n" + line * 500_000 + ">two\nACGT\n")
    t = X.tiles(spark, path, 1024, 1 << 19)
    assert t.rdd.getNumPartitions() > 50
    n, longest, total, chroms = t.agg(F.count("*"), F.max(F.length("seq")), F.sum(F.length("seq")), F.count_distinct("chrom")).first()
    assert (longest, total, chroms) == (1024, 30_000_004, 2) and n == -(-30_000_000 // 1024) + 1
    assert X.tiles(spark, path, 1024, 1 << 19, ["two"]).rdd.getNumPartitions() == 1


def test_irregular_lines_and_stale_indexes_raise(spark, tmp_path):
    path = str(tmp_path / "x.fa")
    open(path, "w").write(">a\nACGT\nAC\nACGT\n>b\nAC\n")
    with pytest.raises(Exception, match="different lengths"):
        X.index(spark, path).collect()
    open(path, "w").write(">a\nACGT\nACGT\nAC\n")
    X.write_index(spark, path)
    open(path, "w").write(">a\nAC\nACGT\nACGT\n")
    with pytest.raises(Exception, match="index"):
        X.tiles(spark, path, 4).collect()


def test_empty_files(spark, tmp_path):
    path = str(tmp_path / "e.fa")
    open(path, "w").close()
    assert X.index(spark, path).count() == 0 and X.tiles(spark, path).count() == 0 and X.contigs(spark, path).count() == 0
