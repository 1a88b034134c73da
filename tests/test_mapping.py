"""Reads planted in a small genome: exact, substituted, with indels, on both strands, in repeats, absent."""

import random

from strandflow.operators import intervals
from strandflow.operators.mapping import map_reads


def distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return -1
    return row[-1] if row[-1] <= most else -1


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_planted_reads(spark):
    rng = random.Random(5)
    unit = "".join(rng.choices("ACGT", k=700))
    word = "".join(rng.choices("ACGT", k=30))
    genome = {"a": "".join(rng.choices("ACGT", k=6000)) + unit + "N" * 50 + "".join(rng.choices("ACGT", k=500)), "b": "".join(rng.choices("acgt", k=4000)) + rc(unit) + "ACGT" * 5, "c": word * 60, "short": "ACG"}
    substituted = list(genome["a"][1000:1400])
    for k in rng.sample(range(400), 9):
        substituted[k] = "ACGT"[("ACGT".index(substituted[k]) + 1) % 4]
    indel = genome["b"][700:900].upper() + "TT" + genome["b"][900:1001].upper() + genome["b"][1004:1100].upper()
    reads = {
        "exact": genome["a"][255:655], "minus": rc(genome["b"][2000:2400].upper()), "substituted": "".join(substituted), "indel": indel, "edge": genome["a"][:300], "end": genome["b"][-320:].upper(),
        "twice": unit[100:500], "repeat": (word * 20)[:400], "absent": "".join(rng.choices("ACGT", k=400)), "tiny": "ACG", "empty": "", "none": None, "lower": genome["a"][3000:3300].lower(),
    }
    g = spark.createDataFrame([(c, s, len(s)) for c, s in genome.items()], "chrom string, seq string, len long")
    df = spark.createDataFrame([*reads.items(), ("exact", reads["exact"])], "id string, seq string")
    got = {r.id: r for r in map_reads(df, intervals.tile(g, 256), hot=20).collect()}
    assert set(got) == set(reads)
    place = lambda x: (got[x].chrom, got[x].start, got[x].end, got[x].strand, got[x].edits, got[x].loci, got[x].unique)
    assert place("exact") == ("a", 255, 655, "+", 0, 1, True) and place("minus") == ("b", 2000, 2400, "-", 0, 1, True)
    assert place("substituted") == ("a", 1000, 1400, "+", 9, 1, True) and place("edge") == ("a", 0, 300, "+", 0, 1, True) and place("lower") == ("a", 3000, 3300, "+", 0, 1, True)
    assert place("end")[:4] == ("b", len(genome["b"]) - 320, len(genome["b"]), "+") and got["end"].unique is False  # the unit in a holds all of it but twenty bases
    assert got["indel"].unique and got["indel"].chrom == "b" and abs(got["indel"].start - 700) <= 3 and 0 < got["indel"].edits <= 10
    assert got["twice"].loci == 2 and not got["twice"].unique and got["repeat"].loci is None and not got["repeat"].unique
    assert all((got[x].loci, got[x].unique, got[x].chrom) == (0, False, None) for x in ("absent", "tiny", "empty", "none"))
    assert distance(reads["substituted"], genome["a"][1000:1400], 20) == 9
    assert distance(indel, genome["b"][got["indel"].start : got["indel"].end].upper(), 20) == got["indel"].edits


def test_registered_mapping_against_all_places(spark, data):
    from strandflow.plans import proxies, registry

    genome = {r.chrom: r.seq for r in proxies.genome(spark, data).collect()}
    got = {r.id: r for r in registry.QUERIES["g09_unique_mapping"](spark, data).collect()}
    reads = {c: s[len(s) // 2 : len(s) // 2 + 150] for c, s in genome.items()}
    assert set(got) == set(genome)
    for c, x in reads.items():
        if max(map(len, x.split("N"))) >= 21:
            other = x[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
            loci = sum(s.startswith(y, k) for s in genome.values() for y in (x, other) for k in [i for i in range(len(s)) if s[i : i + 8] == y[:8]])
            assert (got[c].loci, got[c].unique) == (loci, loci == 1)


def test_copies_are_looked_up_once(spark):
    """Each of 2,000 equal reads has 2,000 places; meeting by every seed gave half a billion rows."""
    import time

    from pyspark.sql import functions as F

    seq = "".join(random.Random(8).choices("ACGT", k=150))
    g = spark.range(2000).select(F.format_string("c%04d", F.col("id")).alias("chrom"), F.lit(seq).alias("seq"), F.lit(150).cast("bigint").alias("len"))
    begun = time.time()
    got = map_reads(g.select(F.col("chrom").alias("id"), "seq"), intervals.tile(g), sample=1, hot=1 << 20, max_edits=0, band=0).collect()
    assert len(got) == 2000 and all((r.loci, r.chrom, r.start, r.unique) == (2000, "c0000", 0, False) for r in got)
    assert time.time() - begun < 60


def test_exact_places_of_torn_tiles_and_heavy_seeds(spark, monkeypatch):
    """Tiles in any order over any partitions, reads over several tiles, seeds above `hot`; all places counted by a plain loop."""
    from pyspark.sql import functions as F

    from strandflow.operators import mapping

    rng = random.Random(11)
    unit, word = "".join(rng.choices("ACGT", k=90)), "".join(rng.choices("ACGT", k=9))
    genome = {"a": "".join(rng.choices("ACGT", k=300)) + unit + "".join(rng.choices("ACGTN", k=201)), "b": unit + rc(unit) + word * 12 + "".join(rng.choices("acgt", k=128)), "c": word * 30, "d": "".join(rng.choices("ACGT", k=64))}
    upper = {c: s.upper() for c, s in genome.items()}
    reads = {f"{c}{i}-{n}": s[i : i + n] for c, s in upper.items() for n in (8, 12, 31, 32, 70, 100) for i in range(0, len(s) - n, 23)} | {"unit": unit, "minus": rc(unit), "word": word * 3, "end": upper["b"][-40:], "absent": "ACGT" * 9, "n": "N" * 20, "half": (word * 2)[:14] + "A" * 15}
    g = spark.createDataFrame([(c, s, len(s)) for c, s in genome.items()], "chrom string, seq string, len long").coalesce(1)
    df = spark.createDataFrame(list(reads.items()), "id string, seq string")
    k = 11
    n = {}
    for s in upper.values():
        for i in range(len(s) - k + 1):
            n[s[i : i + k]] = n.get(s[i : i + k], 0) + 1

    def want(x, hot):
        rarest = {}
        for y in (x, x[::-1].translate(str.maketrans("ACGTN", "TGCAN"))):
            seeds = [y[i : i + k] for i in range(len(y) - k + 1) if "N" not in y[i : i + k]]
            if any(q in n for q in seeds):
                rarest[y] = min(n[q] for q in seeds if q in n)
        if rarest and min(rarest.values()) > hot:
            return None
        strands = [y for y in (x, x[::-1].translate(str.maketrans("ACGTN", "TGCAN"))) if rarest.get(y, hot + 1) <= hot]
        return sum(s.startswith(y, i) for y in strands for s in upper.values() for i in range(len(s)))

    tiles = intervals.tile(g, 32)
    monkeypatch.setattr(mapping, "STRETCH", 200)
    for given, contigs in ((tiles, None), (tiles.repartition(5, F.xxhash64("seq")), None), (tiles, g)):
        for hot in (4, 1 << 20):
            got = {r.id: r for r in map_reads(df, given, k=k, sample=1, hot=hot, max_edits=0, band=0, width=32, contigs=contigs).collect()}
            assert {c: r.loci for c, r in got.items()} == {c: want(x, hot) for c, x in reads.items()}
            assert all(r.chrom is None or upper[r.chrom][r.start : r.end] == (reads[c] if r.strand == "+" else rc(reads[c])) for c, r in got.items() if "N" not in reads[c])


def test_exact_mapping_does_not_shuffle_the_genome(spark, monkeypatch):
    """One read and a genome of 400,000 bases: what is written for it is less than a tenth of the bases."""
    from strandflow.operators import mapping

    rows = [(f"c{i}", "".join(random.Random(i).choices("ACGT", k=20_000)), 20_000) for i in range(20)]
    g = spark.createDataFrame(rows, "chrom string, seq string, len long")
    found, written = [], mapping.stages.written
    monkeypatch.setattr(mapping.stages, "written", lambda df, name: found.append(written(df, name)) or found[-1])
    reads = g.where("chrom = 'c7'").selectExpr("chrom AS id", "substring(seq, 501, 150) AS seq")
    out = map_reads(reads, intervals.tile(g), sample=1, hot=1 << 20, max_edits=0, band=0)
    assert [(r.chrom, r.start, r.loci) for r in out.collect()] == [("c7", 500, 1)]
    assert sum(df.count() for df in found) < 1000
