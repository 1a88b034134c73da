"""bigWig files, made here with both trees several levels deep, against the run-length table that they were made from."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.operators import intervals
from strandflow.sources import bigwig as B


def write(path, sizes, sections, order="<", packed=True, fan=3):
    """sections: (chrom number, kind, step, span, [(start, end, value)]) in order."""
    p = lambda kind, *x: struct.pack(order + kind, *x)
    names = sorted(sizes)
    key = max(map(len, names))
    out = bytearray(64)

    def tree(leaves, leaf_item, inner_item):
        """Writes leaf nodes of `fan` items and inner nodes over them, root last; returns the root's place."""
        level = []
        for k in range(0, len(leaves), fan):
            own = leaves[k : k + fan]
            level.append((len(out), own[0], own[-1]))
            out.extend(p("BBH", 1, 0, len(own)) + b"".join(map(leaf_item, own)))
        while len(level) > 1:
            above = []
            for k in range(0, len(level), fan):
                own = level[k : k + fan]
                above.append((len(out), own[0][1], own[-1][2]))
                out.extend(p("BBH", 0, 0, len(own)) + b"".join(inner_item(*x) for x in own))
            level = above
        return level[0]

    blocks = []
    for chrom, kind, step, span, rows in sections:
        body = p("IIIIIBBH", chrom, rows[0][0], rows[-1][1], step, span, kind, 0, len(rows))
        for s, e, v in rows:
            body += {1: p("IIf", s, e, v), 2: p("If", s, v), 3: p("f", v)}[kind]
        body = zlib.compress(body) if packed else body
        blocks.append((chrom, rows[0][0], rows[-1][1], len(out), len(body)))
        out.extend(body)

    def rooted(head, leaves, leaf_item, inner_item):
        """The root must follow the head, so the nodes below are written first and the root is copied."""
        at, *_ = tree(leaves, leaf_item, inner_item)
        root = bytes(out[at:])
        place = len(out)
        out.extend(head + root)
        return place

    items = [(n.encode().ljust(key, b"\0"), k, sizes[n]) for k, n in enumerate(names)]
    chroms = rooted(p("IIIIQQ", B.CHROMS, fan, key, 8, len(items), 0), items, lambda x: x[0] + p("II", x[1], x[2]), lambda at, a, z: a[0] + p("Q", at))
    index = rooted(p("IIQIIIIQII", B.BLOCKS, fan, len(blocks), 0, 0, 0, 0, 0, 1, 0), blocks, lambda x: p("IIIIQQ", x[0], x[1], x[0], x[2], x[3], x[4]), lambda at, a, z: p("IIIIQ", a[0], a[1], z[0], z[2], at))
    out[:64] = p("IHHQQQHHQQIQ", B.MAGIC, 4, 0, chroms, 64, index, 0, 0, 0, 0, 32768 if packed else 0, 0)
    open(path, "wb").write(out)
    return blocks


@pytest.fixture(scope="module", params=["<", ">"])
def made(request, tmp_path_factory):
    rng = random.Random(3)
    sizes = {"chr1": 90_000, "chr10": 50_000, "chr2": 60_000, "empty": 10, "x": 4000}
    sections, runs = [], []
    for number, name in enumerate(sorted(sizes)):
        at = 0
        while name != "empty" and at < sizes[name] - 2000:
            kind, step, span, rows = rng.choice([1, 2, 3]), rng.randrange(5, 30), rng.randrange(1, 6), []
            for k in range(rng.randrange(1, 40)):
                start = at + (step * k if kind == 3 else 0 if not rows else rows[-1][1] - at + rng.randrange(0, 9))
                end = start + (span if kind > 1 else rng.randrange(1, 50))
                rows.append((start, end, float("nan") if rng.random() < 0.05 else float(np.float32(rng.gauss(0, 1)))))
            sections.append((number, kind, step, span, rows))
            runs += [(name, s, e, 0.0 if v != v else v) for s, e, v in rows]
            at = rows[-1][1] + rng.randrange(0, 300)
    path = str(tmp_path_factory.mktemp("bw") / "x.bw")
    blocks = write(path, sizes, sections, request.param, packed=request.param == "<")
    return path, runs, blocks


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("chunk", [1 << 22, 2000])
def test_whole_file(spark, made, chunk):
    path, runs, blocks = made
    df = B.runs(spark, path, chunk=chunk)
    assert got(df) == sorted(runs) and len(blocks) > 30
    assert chunk > 1 << 20 or df.rdd.getNumPartitions() > 5


@pytest.mark.parametrize("chrom,start,end", [("chr1", 0, 90_000), ("chr10", 20_000, 20_500), ("chr2", 59_999, 60_000), ("empty", 0, 10), ("none", 0, 9), ("x", 100, 100), ("chr1", 777, 778)])
def test_ranges(spark, made, chrom, start, end):
    path, runs, _ = made
    want = sorted(r for r in runs if r[0] == chrom and r[1] < end and r[2] > start)
    if start < end:
        assert got(B.runs(spark, path, (chrom, start, end))) == want
        assert got(B.runs(spark, path).where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))) == want
    else:
        assert got(B.runs(spark, path, (chrom, start, end))) == []


def test_a_range_touches_its_blocks(made):
    path, _, blocks = made
    r = B.Reader({"path": path})
    rest = list(r.pushFilters([B.EqualTo(("chrom",), "chr2"), B.LessThan(("start",), 20_100), B.GreaterThan(("end",), 20_000)]))
    names = sorted({"chr1", "chr10", "chr2", "empty", "x"})
    want = [(at, n) for c, s, e, at, n in blocks if names[c] == "chr2" and s < 20_100 and e > 20_000]
    assert [b for p in r.partitions() for b in p.blocks] == want and 0 < len(want) < 5 and len(rest) == 2


def test_means_equal_the_run_length_path(spark, made):
    path, runs, _ = made
    spans = spark.createDataFrame([("chr1", k * 700, k * 700 + 300) for k in range(100)], "chrom string, start long, end long")
    table = spark.createDataFrame(runs, "chrom string, start long, end long, value double")
    a, b = (sorted((r.start, round(r["mean"], 5)) for r in intervals.span_mean(spans, s).collect()) for s in (B.runs(spark, path), table))
    assert a == b and any(m for _, m in a)


def test_another_file_raises(spark, tmp_path):
    open(tmp_path / "x", "wb").write(b"0" * 100)
    with pytest.raises(Exception, match="not a bigWig"):
        B.runs(spark, str(tmp_path / "x")).collect()
