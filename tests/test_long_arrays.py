"""Segments of long token arrays: the array is looked through once, not once for each place that names it."""

import time

from pyspark.sql import functions as F

from strandflow.operators import tokens as T


def long_rows(spark, n=120, size=20_000):
    return spark.range(n).repartition(4).select("id", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: (k % 7 + 2).cast("int")).alias("a"))


def test_labelled_segments_of_long_arrays(spark):
    begun = time.time()
    z = long_rows(spark).select(F.explode(T.segment_labelled(F.col("a"), F.transform("a", lambda t: t % 3), 23, 2, 3)).alias("z"))
    got = z.select("z.slot", "z.ids", "z.labels").collect()
    assert len(got) == 360 and time.time() - begun < 20
    assert all(len(r.ids) == 23 and len(r.labels) == 23 and r.ids[:4] == [1, 4, 4, 2] for r in got)


def test_bins_of_long_arrays(spark):
    begun = time.time()
    z = long_rows(spark).select("a", T.segment_bins(F.col("a"), 3).alias("z")).select("a", "z").collect()
    assert time.time() - begun < 20
    for r in z[:3]:
        assert [t for s in r.z for t in s] == [t for t in r.a if t not in (T.CLS, T.PAD)]
        assert all(s.count(T.SEP) == 3 and s[-1] == T.SEP for s in r.z[:-1])


def test_bins_of_long_texts(spark):
    """Two million symbols: counting from the start for each piece took their number squared."""
    from strandflow.functions import seq

    begun = time.time()
    df = spark.range(4).repartition(4).select("id", F.repeat(F.lit("ACGTN"), 400_000).alias("s"))
    got = df.select(seq.bins_from_right(F.col("s"), 96).alias("b"), F.reverse("s").alias("r")).collect()
    assert time.time() - begun < 20
    assert all("".join(x[::-1] for x in r.b) == r.r and {len(x) for x in r.b[:-1]} == {96} for r in got)
    none = spark.createDataFrame([("",), (None,)], "s string").select(seq.bins(F.col("s"), 7).alias("b")).collect()
    assert [r.b for r in none] == [[], []]
