"""Totals over overlaps, without pairs."""

import random

from strandflow.operators import intervals as I


def test_overlap_totals_against_all_pairs(spark):
    rng = random.Random(5)
    make = lambda n: [(rng.choice("ab"), s, s + rng.randrange(0, 40)) for s in (rng.randrange(0, 300) for _ in range(n))]
    qs, bs = make(60), make(300) + [("c", 1, 9)]
    frame = lambda x: spark.createDataFrame(x, "chrom string, start long, end long")
    got = {tuple(r)[:3]: (r.n, r.bp) for r in I.overlap_totals(frame(qs), frame(bs), width=64).collect()}
    want = {}
    for c, s, e in {q for q in qs if q[2] > q[1]}:
        met = [min(e, y) - max(s, x) for k, x, y in bs if k == c and x < y and x < e and y > s]
        if met:
            want[c, s, e] = (len(met), sum(met))
    assert got == want


def test_deep_overlaps_are_counted_without_pairs(spark):
    """Ten billion pairs, which no join could list here."""
    deep = spark.range(100_000).selectExpr("'a' as chrom", "id % 100 as start", "id % 100 + 500 as end")
    asked = spark.range(100_000).selectExpr("'a' as chrom", "id % 400 as start", "1000L as end")
    got = I.overlap_totals(asked, deep).collect()
    assert len(got) == 400 and all(r.n == 100_000 for r in got)
    assert {r.start: r.bp for r in got}[0] == 100_000 * 500
