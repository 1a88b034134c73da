"""Two-level scans, moments and interval reads on repeats, at scales and with nulls."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions import metrics as M
from strandflow.operators import intervals as I
from strandflow.operators import ranks, scan


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_running_aggregates_against_a_loop(spark, keys):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), float(x), rng.choice([None, rng.randrange(-9, 9)])) for x in rng.sample(range(-5000, 5000), 600)]
    df = spark.createDataFrame(data, "g string, x double, v int").repartition(5)
    kinds = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.struct("v", "x"))}
    for inclusive in (True, False):
        got = {r.x: r for r in scan.prefix(df, kinds, scan.number_bucket(F.col("x"), 2), (F.col("x"),), keys, inclusive).collect()}
        assert len(got) == len(data)
        for g, x, _ in data:
            seen = [(v, y) for h, y, v in data if (not keys or h == g) and (y < x or inclusive and y == x)]
            values = [v for v, _ in seen if v is not None]
            r = got[x]
            assert (r.total, r.top) == (sum(values), max(values, default=None))
            want = min(seen, key=lambda t: (t[0] is not None, t[0] or 0, t[1]), default=None)
            assert (tuple(r.low) if r.low else None) == want


def test_buckets_ascend_with_numbers(spark):
    rng = random.Random(2)
    xs = sorted({0.0, -0.0, math.inf, -math.inf, 1e-320, -1e-320, 1.7e308, *(s * 2.0**k * (1 + d) for s in (1, -1) for k in range(-40, 40, 3) for d in (0, 1e-15, -1e-16, 0.3)), *(rng.gauss(0, 1) for _ in range(300))})
    rows = spark.createDataFrame([(x,) for x in [*xs, math.nan]], "x double").select("x", scan.number_bucket(F.col("x")).alias("b")).collect()
    order = [r.b for r in sorted(rows, key=lambda r: (math.isnan(r.x), r.x))]
    assert order == sorted(order) and len(set(order)) > len(xs) // 3


def test_scans_leave_no_task_with_all_rows(spark):
    """A curve over 200,000 different scores without keys is scanned in many parts, and equals the plain window."""
    df = spark.range(200_000).select(((F.col("id") * 7919) % 200_003 / 200_003.0).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    parts = df.groupBy(scan.number_bucket(F.col("s"))).count().agg(F.max("count"), F.count("*")).first()
    assert parts[0] < 200 and parts[1] > 4000
    c = M.by_score(df, "y", "s").agg(F.max("tp"), F.max("fp"), F.count("*")).first()
    assert (c[0], c[1], c[2]) == (66667.0, 133333.0, 200_000)
    top = M.by_score(df, "y", "s").orderBy(F.desc("s")).limit(50).collect()
    assert [r.tp + r.fp for r in top] == [float(k) for k in range(1, 51)]


def test_percentiles_and_folds_by_scan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 2.0), ("a", -4.0)], "g string, x double")
    assert sorted((r.g, r.x, r.percentile) for r in ranks.percentile_rank(df, "x", "g").collect()) == [("a", -4.0, 25.0), ("a", 1.0, 62.5), ("a", 1.0, 62.5), ("a", 3.0, 100.0), ("b", 2.0, 100.0)]
    f = ranks.stratified_folds(spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("y")), "y", "doc_id").groupBy("fold", "y").count().collect()
    assert {r["count"] for r in f} == {10}


@pytest.mark.parametrize("scale,mean", [(1e-8, 0.0), (1e-7, 0.0), (1.0, 1e8), (1e8, 1e9), (1e-3, 1e6)])
def test_correlation_at_scales(spark, scale, mean):
    rng = random.Random(3)
    data = [(k % 2, k % 5, mean + scale * k, mean + scale * (2 * k + rng.random())) for k in range(200)]
    df = spark.createDataFrame(data, "g int, part int, x double, y double")
    for g in (0, 1):
        xs, ys = zip(*((x, y) for h, _, x, y in data if h == g), strict=True)
        mx, my = math.fsum(xs) / len(xs), math.fsum(ys) / len(ys)
        want = math.fsum((a - mx) * (b - my) for a, b in zip(xs, ys, strict=True)) / math.sqrt(math.fsum((a - mx) ** 2 for a in xs) * math.fsum((b - my) ** 2 for b in ys))
        one = M.sums(df.where(F.col("g") == g), "x", "y").select(M.correlation().alias("r")).first().r
        merged = M.merge_sums(M.sums(df.where(F.col("g") == g), "x", "y", "part")).select(M.correlation().alias("r")).first().r
        keyed = M.merge_sums(M.sums(df, "x", "y", "g", "part"), "g").where(F.col("g") == g).select(M.correlation().alias("r")).first().r
        assert one == pytest.approx(want, abs=1e-6) and merged == pytest.approx(want, abs=1e-6) and keyed == pytest.approx(want, abs=1e-6)


def test_correlation_without_variance_and_with_nulls(spark):
    df = spark.createDataFrame([("c", 0.1, 1.0), ("c", 0.1, 2.0), ("c", 0.1, 5.0), ("n", None, 7.0), ("n", 1.0, 2.0), ("n", 2.0, 4.0), ("n", 3.0, None), ("e", None, 1.0)], "g string, x double, y double")
    got = {r.g: r.r for r in M.sums(df, "x", "y", "g").select("g", M.correlation().alias("r")).collect()}
    assert got["c"] is None and got["n"] == pytest.approx(1.0) and got["e"] is None
    masked = {r.g: r for r in M.masked_pearson(df.withColumn("m", F.lit(True)), "x", "y", "m", "g").collect()}
    assert masked["c"].r == 0.0 and masked["n"].mse == pytest.approx(2.5) and masked["e"].mse == 0.0


def test_reads_of_repeated_intervals(spark):
    tiles = I.tile(spark.createDataFrame([("c", "ACGTACGTAC", 10)], "chrom string, seq string, len long"), 4)
    df = spark.createDataFrame([("c", 2, 6, "n"), ("c", 2, 6, "n"), ("c", 2, 6, None), ("c", 8, 30, "end"), ("c", 3, 3, "none"), ("d", 0, 4, "other"), (None, 0, 4, "null")], "chrom string, start long, end long, name string")
    assert sorted((str(r.name), r.sequence) for r in I.get_fasta(df, tiles, 4).collect()) == [("None", "GTAC"), ("end", "AC"), ("n", "GTAC"), ("n", "GTAC")]
    regions = spark.createDataFrame([("c:3-6",), ("c:3-6",), ("c:1",), ("bad",)], "region string")
    assert sorted(r.sequence for r in I.fetch_regions(regions, tiles, 4).collect()) == ["A", "GTAC", "GTAC"]


def test_means_of_repeated_spans(spark):
    signal = spark.createDataFrame([("c", 0, 10, 2.0), ("c", 10, 20, None)], "chrom string, start long, end long, value double")
    spans = spark.createDataFrame([("c", 0, 10, "a"), ("c", 0, 10, "a"), ("c", 5, 15, None), ("c", 4, 4, "e"), (None, 0, 2, "n"), ("c", None, 2, "m")], "chrom string, start long, end long, name string")
    got = sorted(((str(r.name), r.mean) for r in I.span_mean(spans, signal).collect()), key=str)
    assert got == [("None", 1.0), ("a", 2.0), ("a", 2.0), ("e", None), ("m", None), ("n", 0.0)]
