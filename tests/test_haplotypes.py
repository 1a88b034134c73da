"""Variation documents against a plain loop over whole strings, and on a contig of 50 million bases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strandflow import cli
from strandflow.operators import haplotypes as H
from strandflow.operators import intervals

COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def loop(seq, windows, sites, samples, density, max_n):
    """Every document's text of one contig, by walking strings; sites: (pos, ref, alts, {sample: (a1, a2)})."""
    out = {}
    for idx, start, end, lengths in windows:
        ref = seq[start:end]
        inside = [s for s in sites if start <= s[0] - 1 < end]
        if ref.count("N") > max_n * len(ref) or not inside:
            continue
        for sample in samples:
            calls = [s[3].get(sample, (-1, -1)) for s in inside]
            vcs = sum(a != -1 for a, _ in calls)
            if not any(a > 0 for a, _ in calls) or vcs < density * len(ref):
                continue
            haps = []
            for h in (0, 1):
                text, done = "", 0
                for (pos, r, alts, _), call in zip(inside, calls, strict=True):
                    lp = pos - 1 - start
                    if lp < done:
                        continue
                    a = call[h] if call[0] != -1 else 0
                    text += ref[done:lp] + ([r, *alts][a] if a >= 0 else r)
                    done = lp + len(r)
                haps.append(text + ref[done:])
            for h, text in enumerate(haps[: 1 + (haps[0] != haps[1])]):
                for strand, t, ls in (("+", text, lengths), ("-", text[::-1].translate(COMPLEMENT), lengths[::-1])):
                    cut, at = [], 0
                    for n in ls:
                        cut.append(t[at : at + n])
                        at += n
                    out[idx, sample, h + 1, strand] = (cut, vcs, len(ref), len(lengths))
    return out


def test_documents_against_a_loop(spark):
    rng = random.Random(8)
    seqs = {"a": "".join(rng.choices("ACGTN", [5, 5, 5, 5, 1], k=4000)), "b": "".join(rng.choices("ACGTN", [1, 1, 1, 1, 9], k=1500)), "c": "".join(rng.choices("ACGT", k=999)), "tiny": "ACGT"}
    options = {"start": 60, "sentence": (40, 90), "document": (3, 6)}
    contigs = spark.createDataFrame([(c, s, len(s)) for c, s in seqs.items()], "chrom string, seq string, len long")
    tiles = intervals.tile(contigs, 64)
    w = {}
    for r in H.windows(contigs.select("chrom", "len"), "t", **options).collect():
        w.setdefault(r.chrom, []).append((r.doc_idx, r.start, r.end, r.lengths))
    for c, x in w.items():
        x.sort()
        assert 0 <= x[0][1] <= 60 and all(p[2] == q[1] for p, q in zip(x, x[1:])) and x[-1][2] < len(seqs[c])
        assert all(end - start == sum(ls) and 40 <= min(ls) and max(ls) <= 90 and len(ls) <= 6 and start + 90 < len(seqs[c]) for _, start, end, ls in x)
        assert all(len(ls) >= 3 for *_, ls in x[:-1]) and len(seqs[c]) - x[-1][2] <= 2 * 90
    assert "tiny" not in w
    rows, sites = [], {}
    for c in ("a", "b", "c"):
        pos = 0
        while (pos := pos + rng.randrange(1, 30)) <= len(seqs[c]):
            ref = seqs[c][pos - 1 : pos - 1 + rng.choice([1, 1, 1, 2, 40])]
            alts = rng.sample(["A", "G", "CTT", "TACGTACGTACGTACG"], rng.choice([1, 2]))
            calls = {s: rng.choice([(-1, 0), (0, 0), (1, 0), (0, len(alts)), (1, 1), (1, -1)]) for s in ("x", "y", "z") if rng.random() < 0.9 and (s != "z" or pos < 700)}
            sites.setdefault(c, []).append((pos, ref, alts, calls))
            rows += [(c, pos, ref, alts, s, *g) for s, g in calls.items()]
    calls = spark.createDataFrame(rows, "chrom string, pos long, ref string, alts array<string>, sample string, a1 int, a2 int")
    got = {(r.chrom, r.doc_idx, r.sample, r.haplotype, r.strand): (r.text, r.vcs, r.len, r.snt) for r in H.documents(contigs.select("chrom", "len"), tiles, calls, "t", 0.04, 0.3, width=64, **options).collect()}
    # sites without any call are not in the table of calls, so the loop does not know them either
    want = {(c, *k): v for c in sites for k, v in loop(seqs[c], w.get(c, []), [s for s in sites[c] if s[3]], ("x", "y", "z"), 0.04, 0.3).items()}
    assert got == want and len(want) > 60 and len({k[0] for k in want}) > 1
    assert any(len("".join(v[0])) < v[2] for v in want.values())


def test_a_contig_of_fifty_million_bases(spark):
    """Tiles come from a range, so nothing is ever as long as the contig; cells are documents at most."""
    size, width = 50_000_000, 1024
    tiles = spark.range(-(-size // width)).select(F.lit("big").alias("chrom"), F.col("id").alias("tile_idx"), F.substring(F.repeat(F.lit("ACGTTGCA"), width // 8), 1, F.least(F.lit(width), F.lit(size) - F.col("id") * width).cast("int")).alias("seq"), F.lit(size).cast("long").alias("len"))
    contigs = spark.createDataFrame([("big", size)], "chrom string, len long")
    w = H.windows(contigs, "big")
    n, low, high, longest = w.agg(F.count("*"), F.min("start"), F.max("end"), F.max(F.col("end") - F.col("start"))).first()
    assert low <= 5000 and size - 2000 <= high < size and longest <= 100_000 and n > 500
    sites = spark.range(0, 40_000).select(F.lit("big").alias("chrom"), (F.col("id") * 50 + 20_001).alias("pos"), F.substring(F.lit("ACGTTGCA"), (F.col("id") * 50 + 20_000) % 8 + 1, F.lit(1)).alias("ref"), F.array(F.lit("GG")).alias("alts"), F.lit("s").alias("sample"), F.lit(1).alias("a1"), F.lit(0).alias("a2"))
    out = H.documents(contigs, tiles, sites, "big").agg(F.count("*"), F.max(F.aggregate("text", F.lit(0), lambda a, x: a + F.length(x))), F.count_distinct("doc_idx")).first()
    assert out[0] == 4 * out[2] and out[2] > 20 and out[1] <= 100_000


@pytest.mark.parametrize("mode", ["jsonl", "single_txt"])
def test_command_line(spark, tmp_path, mode):
    rng = random.Random(4)
    seq = "".join(rng.choices("ACGT", k=5000))
    open(tmp_path / "g.fa", "w").write(">c1 x\n" + "".join(seq[k : k + 60] + "\n" for k in range(0, 5000, 60)))
    lines = "".join(f"c1\t{p}\t.\t{seq[p - 1]}\t{'A' if seq[p - 1] != 'A' else 'C'}\t.\t.\t.\tGT\t0|1\t1|1\n" for p in range(5, 4990, 20))
    open(tmp_path / "v.vcf", "w").write("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n" + lines)
    cli.main(["alleles", "--reference", f"{tmp_path}/g.fa", "--vcf", f"{tmp_path}/v.vcf", "--output-dir", f"{tmp_path}/o", "--io-mode", mode, "--sentence", "50", "100", "--document", "5", "10", "--start", "10"])
    if mode == "jsonl":
        docs = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/o").collect()]
        # the first allele of s1 is always the reference, so only s2 is used, and its haplotypes are equal
        assert {d["sample"] for d in docs} == {"s2"} and {d["haplotype"] for d in docs} == {1} and {d["VF"] for d in docs} == {"0.05"}
        assert all(len(d["text"]) == d["snt"] and sum(map(len, d["text"])) == d["len"] for d in docs)
    else:
        assert {len(r.value) > 0 for r in spark.read.text(f"{tmp_path}/o").collect()} == {True}
