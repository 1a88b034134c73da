"""BGZF and tabix against the plain reader; blocks touched are counted; files are made here block by block."""

import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from strandflow.sources import readers
from strandflow.sources import vcf_indexed as V


def block(content):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(content) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(content), len(content))


def bin_of(start, end):
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def write(path, lines, header, size=700):
    """A BGZF file with blocks of `size` bytes, lines running over their borders, and its tabix index."""
    text = header + b"".join(lines)
    places, out = [], b""
    for k in range(0, len(text), size):
        places.append(len(out))
        out += block(text[k : k + size])
    end = len(out) << 16
    open(path, "wb").write(out + block(b""))
    virtual = lambda at: places[at // size] << 16 | at % size if at < len(text) else end
    names, bins, linear, at = [], {}, {}, len(header)
    for x in lines:
        chrom, pos, _, ref = x.split(b"\t")[:4]
        start, stop = int(pos) - 1, int(pos) - 1 + len(ref)
        if chrom not in names:
            names.append(chrom)
        a, b = virtual(at), virtual(at + len(x))
        bins.setdefault(chrom, {}).setdefault(bin_of(start, stop), []).append((a, b))
        for w in range(start >> 14, (stop - 1 >> 14) + 1):
            linear.setdefault(chrom, {}).setdefault(w, a)
        at += len(x)
    body = b"TBI\1" + struct.pack("<8i", len(names), 2, 1, 2, 0, 35, 0, sum(len(n) + 1 for n in names)) + b"".join(n + b"\0" for n in names)
    for n in names:
        body += struct.pack("<i", len(bins[n])) + b"".join(struct.pack("<Ii", k, len(v)) + b"".join(struct.pack("<QQ", *c) for c in v) for k, v in bins[n].items())
        top = max(linear[n]) + 1
        filled, last = [], 0
        for w in range(top):
            last = linear[n].get(w, last)
            filled.append(last)
        body += struct.pack("<i", top) + struct.pack(f"<{top}Q", *filled)
    open(f"{path}.tbi", "wb").write(b"".join(block(body[k : k + 60000]) for k in range(0, len(body), 60000)) + block(b""))
    return len(places)


def sites(rng, samples, n=900):
    header = b"##x\n##y=" + b"z" * 900 + b"\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + b"\t".join(b"s%d" % k for k in range(samples)) + b"\n"
    lines = []
    for chrom in (b"chr1", b"chr2", b"chr10"):
        pos = 0
        for _ in range(n):
            pos += rng.randrange(1, 3000)
            calls = b"\t".join(rng.choice([b"0|1:3", b"./.", b"1/1", b".|.", b"0/0:9", b"1"]) for _ in range(samples))
            lines.append(b"\t".join([chrom, b"%d" % pos, b"v%d" % pos, rng.choice([b"A", b"ACGT"]), rng.choice([b"C", b"C,G"]), b".", b".", rng.choice([b".", b"K=1;F", b"K=a=b"]), b"GT", calls]) + b"\n")
    return header, lines


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    folder = tmp_path_factory.mktemp("vcf")
    header, lines = sites(random.Random(1), 5)
    path = str(folder / "x.vcf.gz")
    n = write(path, lines, header)
    open(folder / "x.vcf", "wb").write(header + b"".join(lines))
    return path, str(folder / "x.vcf"), n


def plain(df):
    return sorted((r.chrom, r.pos, r.id, r.ref, tuple(r.alts), tuple(sorted(r.info.items())), tuple(map(tuple, r.gts))) for r in df.collect())


@pytest.mark.parametrize("chunk", [1 << 24, 20_000, 900, 150])
def test_whole_file_in_parts(spark, made, chunk):
    packed, text, _ = made
    df = V.vcf(spark, packed, chunk=chunk)
    assert plain(df) == plain(readers.vcf(spark, text))
    assert chunk > 1 << 20 or df.rdd.getNumPartitions() > 3


@pytest.mark.parametrize("chrom,start,end", [("chr1", 0, 50_000), ("chr2", 400_000, 403_000), ("chr10", 1_000_000, 1 << 29), ("chr1", 16383, 16385), ("chr3", 0, 10), ("chr2", 5, 5)])
def test_regions_and_samples(spark, made, chrom, start, end):
    packed, text, _ = made
    want = plain(readers.vcf(spark, text, ["s3", "s0"], (chrom, start, end)))
    assert plain(V.vcf(spark, packed, ["s3", "s0"], (chrom, start, end))) == want
    assert plain(V.vcf(spark, packed, ["s3", "s0"], (chrom, start, end), chunk=1200)) == want
    pushed = V.vcf(spark, packed, ["s3", "s0"]).where((F.col("chrom") == chrom) & (F.col("pos") > start) & (F.col("pos") <= end))
    assert plain(pushed) == want


def test_a_region_touches_its_blocks_only(made, monkeypatch):
    packed, _, n = made
    seen = []
    real = V.zlib.decompress
    reader = V.VcfReader({"path": packed, "chrom": "chr2", "start": "600000", "end": "640000"})
    parts = reader.partitions()
    own = sum((p.end >> 16) - (p.start >> 16) for p in parts)
    monkeypatch.setattr(V.zlib, "decompress", lambda *a: seen.append(1) or real(*a))
    rows = sum(b.num_rows for p in parts for b in reader.read(p))
    assert rows > 5 and own < 20_000 and len(seen) < n // 3


def test_pushed_conditions_reach_the_source(made):
    packed, _, _ = made
    r = V.VcfReader({"path": packed})
    rest = list(r.pushFilters([V.EqualTo(("chrom",), "chr1"), V.GreaterThan(("pos",), 100), V.LessThanOrEqual(("pos",), 200), V.EqualTo(("id",), "v")]))
    assert (r.chrom, r.low, r.high) == ("chr1", 100, 200) and len(rest) == 1 and all(not p.search for p in r.partitions())
    assert not list(r.pushFilters([V.EqualTo(("chrom",), "chr2")])) and r.partitions() == []


def test_thousands_of_samples_plan_quickly(spark, tmp_path):
    header, lines = sites(random.Random(2), 3000, 3)
    path = str(tmp_path / "w.vcf.gz")
    write(path, lines, header, 60_000)
    V.vcf(spark, path, ["s1"]).schema  # the first use starts a worker
    began = time.perf_counter()
    df = V.vcf(spark, path).select("chrom", "pos", F.size("gts").alias("n"))
    df._jdf.queryExecution().optimizedPlan()
    assert time.perf_counter() - began < 5
    assert {r.n for r in df.collect()} == {3000} and df.count() == 9
    with pytest.raises(Exception, match="no such samples"):
        V.vcf(spark, path, ["zz"]).collect()
