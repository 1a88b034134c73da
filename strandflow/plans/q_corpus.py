"""Corpus and dataset builders end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.functions import seq
from strandflow.operators import corpus, datasets, haplotypes, intervals, mapping
from strandflow.operators import variants as V

from . import proxies as P
from .q_intervals import _IV, _iv, merged
from .registry import ORACLES, query

v, hs = P.with_views, P.hash_sql
C = F.col


def _sentences(source: str, seed: str) -> str:
    """Options of the small proxies: starts in 0..50, sentences of 50..100, documents of 5..10 sentences."""
    r = repr(seed)
    return f"""q AS (SELECT chrom, len, seq, {hs(r, "'q'", 'chrom')} % 51 AS q0 FROM {source}), i AS (SELECT *, unnest(range(0, (len - q0) // 50 + 1)) AS i FROM q WHERE q0 < len),
n AS (SELECT chrom, len, seq, q0, i, 50 + {hs(r, "'s'", 'chrom', 'i::VARCHAR')} % 51 AS n FROM i), st AS (SELECT *, q0 + coalesce(sum(n) OVER (PARTITION BY chrom ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM n),
sen AS (SELECT chrom, i, s, least(n, len - s) AS n, seq FROM st WHERE s < len), m AS (SELECT chrom, count(*) AS m FROM sen GROUP BY chrom), dk AS (SELECT chrom, unnest(range(0, m // 5 + 1)) AS d FROM m),
du AS (SELECT chrom, d, 5 + {hs(r, "'d'", 'chrom', 'd::VARCHAR')} % 6 AS k FROM dk), db AS (SELECT chrom, d, sum(k) OVER (PARTITION BY chrom ORDER BY d ROWS UNBOUNDED PRECEDING) AS upto, k FROM du),
doc AS (SELECT sen.chrom, d, i, upper(substr(seq, (s + 1)::BIGINT, n::BIGINT)) AS t FROM sen JOIN db ON sen.chrom = db.chrom AND i < upto AND i >= upto - k)"""


_SMALL = {"start": 50, "sentence": (50, 100), "document": (5, 10)}
_DOCS = " SELECT chrom, d AS doc_idx, count(*) AS n, md5(string_agg(t, '|' ORDER BY i)) AS digest FROM doc GROUP BY 1, 2"


def _digest(docs):
    return docs.select("chrom", "doc_idx", F.size("text").cast("bigint").alias("n"), F.md5(F.array_join("text", "|")).alias("digest"))


@query("g01_documents", v("genome", _sentences("genome", "g01") + _DOCS))
def g01(s, d):
    return _digest(corpus.documents(P.genome(s, d), "g01", **_SMALL))


@query("g02_genome_corpus", v("genome", "both_ AS (SELECT chrom, seq, len FROM genome WHERE len >= 600 UNION ALL SELECT 'rc_' || chrom, reverse(translate(seq, 'ACTGN', 'TGACN')), len FROM genome WHERE len >= 600), " + _sentences("both_", "g02") + _DOCS))
def g02(s, d):
    return _digest(corpus.documents(corpus.both_strands(P.genome_written(s, d).where("len >= 600")), "g02", **_SMALL))


_VAR = "vr AS (SELECT chrom, len, seq, unnest(range(0, len // 40)) * 40 + 7 AS p0, substr(seq, p0 + 1, 1) AS ref FROM genome WHERE len >= 200), vv AS (SELECT *, CASE WHEN ref = 'A' THEN 'GT' ELSE 'A' END AS alt, p0 // 40 AS k FROM vr), sa AS (SELECT unnest(range(1, 4)) AS j), gg AS (SELECT chrom, p0, ref, alt, 's' || j AS sample, CASE WHEN (k + j) % 7 = 0 THEN -1 ELSE (k * j) % 2 END AS a1, (k + j) % 2 AS a2 FROM vv, sa)"


@query("g03_consensus", v("genome", _VAR + """,
u AS (SELECT chrom, sample FROM gg GROUP BY 1, 2 HAVING bool_or(a1 > 0)), h AS (SELECT chrom, sample, p0, ref, alt, unnest([1, 2]) AS h, unnest([a1, a2]) AS a FROM gg),
x AS (SELECT chrom, sample, h, p0, CASE WHEN a > 0 THEN alt ELSE ref END AS al, coalesce(lag(p0) OVER (PARTITION BY chrom, sample, h ORDER BY p0) + 1, 0) AS cur FROM h),
b AS (SELECT x.chrom, x.sample, x.h, string_agg(substr(seq, cur + 1, p0 - cur) || al, '' ORDER BY p0) || substr(any_value(seq), max(p0) + 2) AS s FROM x JOIN u USING (chrom, sample) JOIN genome USING (chrom) GROUP BY 1, 2, 3),
c AS (SELECT *, lag(s) OVER (PARTITION BY chrom, sample ORDER BY h) AS p FROM b) SELECT chrom, sample, h::INT AS haplotype, md5(s) AS digest FROM c WHERE p IS NULL OR p <> s"""))
def g03(s, d):
    g = P.genome_written(s, d).where("len >= 200")
    vs = intervals.tile(g, 40).where("length(seq) = 40").select("chrom", C("tile_idx").alias("k"), (C("tile_idx") * 40 + 8).alias("pos"), F.substring("seq", 8, 1).alias("ref"))
    j = F.explode(F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3)))).alias("j")
    calls = vs.select("chrom", "pos", "ref", F.array(F.when(C("ref") == "A", "GT").otherwise("A")).alias("alts"), "k", j)
    calls = calls.select("chrom", "pos", "ref", "alts", F.concat(F.lit("s"), C("j").cast("string")).alias("sample"), F.when((C("k") + C("j")) % 7 == 0, -1).otherwise(C("k") * C("j") % 2).alias("a1"), ((C("k") + C("j")) % 2).alias("a2"))
    w = g.select(C("chrom").alias("doc"), "chrom", F.lit(0).cast("bigint").alias("start"), C("len").alias("end"), "seq")
    return V.consensus(w, calls).select(C("doc").alias("chrom"), "sample", "haplotype", F.md5("seq").alias("digest"))


#: A site every 40 bases, each fifth a deletion of two bases, others substitutions and insertions; each seventh has a second site that its deletion may cover.
_SITES = """w0 AS (SELECT chrom, len, seq, unnest(range(0, (len - 8) // 40 + 1)) AS k FROM genome WHERE len >= 8),
sites AS (SELECT chrom, 40 * k + 7 AS p, k, 0 AS b, substr(seq, (40 * k + 8)::BIGINT, CASE WHEN k % 5 = 0 THEN 3 ELSE 1 END) AS ref, CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN substr(seq, (40 * k + 8)::BIGINT, 1) || 'GT' ELSE 'C' END AS alt FROM w0
  UNION ALL SELECT chrom, 40 * k + 8, k, 1, substr(seq, (40 * k + 9)::BIGINT, 1), 'T' FROM w0 WHERE k % 7 = 0 AND 40 * k + 8 < len),
calls AS (SELECT *, 's' || j AS sample, CASE WHEN (k + j) % 7 = 0 THEN -1 ELSE (k * j) % 2 END AS a1, (k + j) % 2 AS a2 FROM sites, (SELECT unnest([1, 2, 3]) AS j))"""
_SMALL_WINDOWS = f"""q AS (SELECT chrom, len, seq, {hs("'g03d'", "'q'", 'chrom')} % 51 AS q0 FROM genome), i AS (SELECT *, unnest(range(0, (len - q0) // 50 + 1)) AS i FROM q WHERE q0 + 100 < len),
n AS (SELECT chrom, len, seq, q0, i, 50 + {hs("'g03d'", "'s'", 'chrom', 'i::VARCHAR')} % 51 AS n FROM i), st AS (SELECT *, q0 + coalesce(sum(n) OVER (PARTITION BY chrom ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM n),
sen AS (SELECT * FROM st WHERE s + n < len), dk AS (SELECT chrom, unnest(range(0, count(*) // 5 + 1)) AS d FROM sen GROUP BY chrom), du AS (SELECT *, 5 + {hs("'g03d'", "'d'", 'chrom', 'd::VARCHAR')} % 6 AS k FROM dk),
db AS (SELECT chrom, d, sum(k) OVER (PARTITION BY chrom ORDER BY d ROWS UNBOUNDED PRECEDING) AS upto, k FROM du),
win AS (SELECT sen.chrom, d, min(s)::BIGINT AS st, max(s + n)::BIGINT AS en, list(n ORDER BY i) AS lens, any_value(len) AS len, substr(any_value(seq), min(s)::BIGINT + 1, (max(s + n) - min(s))::BIGINT) AS ref FROM sen JOIN db ON sen.chrom = db.chrom AND i < upto AND i >= upto - k GROUP BY 1, 2 HAVING min(s) + 100 < any_value(len)),
ok AS (SELECT * FROM win WHERE en - st - length(replace(ref, 'N', '')) <= 0.06 * (en - st))"""


@query("g03_documents", v("genome", f"{_SITES}, {_SMALL_WINDOWS}," + """
c AS (SELECT ok.chrom, d, st, en, lens, ok.ref AS text, p - st AS lp, length(calls.ref) AS n, calls.ref, alt, sample, a1, a2, b = 1 AND k % 5 = 0 AND p - 1 >= st AS covered FROM ok JOIN calls ON calls.chrom = ok.chrom AND p >= st AND p < en),
u AS (SELECT chrom, d, sample, count(*) FILTER (a1 <> -1) AS vcs FROM c GROUP BY chrom, d, sample, en, st HAVING bool_or(a1 > 0) AND count(*) FILTER (a1 <> -1) >= 0.022 * (en - st)),
h AS (SELECT c.*, vcs, unnest([1, 2]) AS h, unnest([CASE WHEN a1 > 0 THEN alt ELSE ref END, CASE WHEN a1 <> -1 AND a2 > 0 THEN alt ELSE ref END]) AS al FROM c JOIN u USING (chrom, d, sample) WHERE NOT covered),
x AS (SELECT *, coalesce(lag(lp + n) OVER (PARTITION BY chrom, d, sample, h ORDER BY lp), 0) AS cur FROM h),
f AS (SELECT chrom, d, sample, h, any_value(vcs) AS vcs, any_value(en - st) AS size, any_value(lens) AS lens, string_agg(substr(text, cur + 1, greatest(lp - cur, 0)) || al, '' ORDER BY lp) || substr(any_value(text), max(lp + n) + 1) AS s FROM x GROUP BY 1, 2, 3, 4),
g AS (SELECT *, lag(s) OVER (PARTITION BY chrom, d, sample ORDER BY h) AS before FROM f),
both_ AS (SELECT *, unnest(['+', '-']) AS strand, unnest([s, reverse(translate(s, 'ACTGN', 'TGACN'))]) AS t, unnest([lens, list_reverse(lens)]) AS l FROM g WHERE before IS NULL OR before <> s),
cut AS (SELECT *, list_transform(range(1, len(l) + 1), lambda k: substr(t, (coalesce(list_sum(l[1 : k - 1]), 0) + 1)::BIGINT, l[k])) AS sentences FROM both_)
SELECT chrom, d AS doc_idx, sample, h::INT AS haplotype, strand, md5(array_to_string(sentences, '|')) AS digest, vcs, size::BIGINT AS len, len(lens)::INT AS snt FROM cut"""))
def g03_documents(s, d):
    g = P.genome_written(s, d)
    t = intervals.tile(g, 40).select("chrom", C("tile_idx").alias("k"), "seq").where("length(seq) >= 8")
    one = t.select("chrom", "k", (C("k") * 40 + 8).alias("pos"), F.substring(C("seq"), F.lit(8), F.when(C("k") % 5 == 0, 3).otherwise(1)).alias("ref"), F.when(C("k") % 3 == 0, "A").when(C("k") % 3 == 1, F.concat(F.substring("seq", 8, 1), F.lit("GT"))).otherwise("C").alias("alt"))
    two = t.where("k % 7 = 0 and length(seq) >= 9").select("chrom", "k", (C("k") * 40 + 9).alias("pos"), F.substring("seq", 9, 1).alias("ref"), F.lit("T").alias("alt"))
    j = F.explode(F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3)))).alias("j")
    x = one.unionByName(two).select("*", j)
    calls = x.select("chrom", "pos", "ref", F.array("alt").alias("alts"), F.concat(F.lit("s"), C("j").cast("string")).alias("sample"), F.when((C("k") + C("j")) % 7 == 0, -1).otherwise((C("k") * C("j") % 2).cast("int")).alias("a1"), ((C("k") + C("j")) % 2).cast("int").alias("a2"))
    docs = haplotypes.documents(g.select("chrom", "len"), intervals.tile(g, haplotypes.TILE), calls, "g03d", min_density=0.022, max_n=0.06, **_SMALL)
    return docs.select("chrom", "doc_idx", "sample", "haplotype", "strand", F.md5(F.array_join("text", "|")).alias("digest"), "vcs", "len", "snt")


_HR = 'hr AS (SELECT chrom, "start", "end", name FROM iv WHERE name % 3 = 0)'
_HM = merged(200, "hl").replace("z AS", "hz AS").replace("FROM z)", "FROM hz)").replace("y AS", "hy AS").replace("FROM y ", "FROM hy ")


@query("g05_holdout", v("genome", f"{_IV}, {_HR}, hl AS (SELECT chrom, \"start\", \"end\" FROM hr), {_HM}, sizes AS (SELECT chrom, len FROM genome WHERE len >= 100), " + """g AS (SELECT chrom, coalesce(lag("end") OVER (PARTITION BY chrom ORDER BY "start"), 0) AS s, "start" AS e FROM merged
UNION ALL SELECT chrom, max("end"), len FROM merged JOIN sizes USING (chrom) GROUP BY chrom, len UNION ALL SELECT chrom, 0, len FROM sizes WHERE chrom NOT IN (SELECT chrom FROM hl)),
a AS (SELECT 'sp_' || chrom || '_' || "start" || '_' || "end" || '_test' AS name, chrom, "start" AS s, "end" AS e FROM merged UNION ALL SELECT 'sp_' || chrom || '_' || s || '_' || e || '_train', chrom, s, e FROM g WHERE s < e)
SELECT name, md5(substr(seq, s + 1, e - s)) AS digest FROM a JOIN genome USING (chrom)"""))
def g05(s, d):
    g = P.genome_written(s, d)
    sizes = g.where("len >= 100").select("chrom", "len")
    ref = _iv(s, d, g).where(F.split_part("name", F.lit(":"), F.lit(2)).cast("int") % 3 == 0).select("chrom", "start", "end", "name")
    blocks = sizes.select("chrom", F.lit(0).cast("bigint").alias("start"), C("len").alias("end"), C("chrom").alias("to_chrom"), F.lit(0).cast("bigint").alias("to_start"), F.lit("+").alias("to_strand"))
    _, records = datasets.holdout(ref, blocks, sizes, intervals.tile(g, 2048), "sp", 200, 2048)
    return records.select("name", F.md5("sequence").alias("digest"))


_BK = ", ".join(f"struct_pack(u := {hs(repr('g06'), repr('pick'), 'name', repr(str(k)))}, k := {k})" for k in range(20))


@query("g06_promoter_dataset", v("genome", f"g AS (SELECT chrom AS name, substr(seq, 1, least(16000, len // 20 * 20)) AS s FROM genome), p AS (SELECT name, s, length(s) // 20 AS w, list_transform(list_sort([{_BK}])[1:12], lambda x: x.k) AS picked FROM g), q AS (SELECT *, list_sort(picked) AS places FROM p) SELECT name, s AS sequence, 1 AS promoter_presence FROM q UNION ALL SELECT name, array_to_string(list_transform(range(0, 20), lambda k: CASE WHEN list_contains(places, k::INT) THEN substr(s, (picked[list_position(places, k::INT)] * w + 1)::BIGINT, w) ELSE substr(s, k * w + 1, w) END), ''), 0 FROM q"))
def g06(s, d):
    """Cut at 16,000 and trimmed to a multiple of 20, as f11 does."""
    g = P.genome(s, d).select(C("chrom").alias("name"), F.expr("substring(seq, 1, int(len div 20 * 20))").alias("sequence"))
    return datasets.promoter_dataset(g, 16_000, "g06")


_GP = 'gp AS (SELECT chrom, (len // 5)::BIGINT AS "start", (len // 5 + 80)::BIGINT AS "end", chrom AS name FROM genome WHERE len > 300)'


def _gp(g):
    return g.where("len > 300").select("chrom", F.expr("len div 5").alias("start"), (F.expr("len div 5") + 80).alias("end"), C("chrom").alias("name"))


_NEG = """cd AS (SELECT chrom, n, len, unnest(range(1, greatest(4, n * 4) + 1)) AS t FROM wn JOIN genome USING (chrom) WHERE len > {L}), ck AS (SELECT chrom, n, t, {u} % (len - {L} + 1) AS s FROM cd),
cf AS (SELECT * FROM ck WHERE NOT EXISTS (SELECT 1 FROM gp b WHERE b.chrom = ck.chrom AND ck.s < b."end" AND ck.s + {L} > b."start")), cr AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY t) AS j FROM cf), ng AS (SELECT DISTINCT chrom, s, s + {L} AS e FROM cr WHERE j <= n)"""
_SPLIT = "CASE WHEN chrom IN ('d8', 'd9', 'd88') THEN 'test' WHEN chrom IN ('d10', 'd100') THEN 'valid' ELSE 'train' END AS split"
_TEST, _VALID = ("d8", "d9", "d88"), ("d10", "d100")


def _win(c: str, L: int) -> str:
    return f"CASE WHEN greatest(0, {c} - {L // 2}) + {L} > len THEN greatest(0, len - {L}) ELSE greatest(0, {c} - {L // 2}) END AS s, CASE WHEN greatest(0, {c} - {L // 2}) + {L} > len THEN len ELSE greatest(0, {c} - {L // 2}) + {L} END AS e"


@query("g07_peak_dataset", v("genome", f"{_GP}, w AS (SELECT DISTINCT chrom, {_win('(\"start\" + \"end\") // 2', 120)} FROM gp JOIN genome USING (chrom)), ps AS (SELECT chrom, s, e, substr(seq, s + 1, 120) AS q FROM w JOIN genome USING (chrom) WHERE e - s = 120), po AS (SELECT * FROM ps WHERE strpos(q, 'N') = 0), wn AS (SELECT chrom, count(*) AS n FROM po GROUP BY chrom), " + _NEG.format(L=120, u=hs("'g07'", "chrom", "t::VARCHAR")) + f", al AS (SELECT chrom, s, e, q, 1 AS label FROM po UNION ALL SELECT chrom, s, e, substr(seq, s + 1, 120), 0 FROM ng JOIN genome USING (chrom) WHERE strpos(substr(seq, s + 1, 120), 'N') = 0) SELECT chrom, s AS \"start\", e AS \"end\", q AS sequence, label, {_SPLIT} FROM al"))
def g07(s, d):
    g = P.genome_written(s, d)
    return datasets.peak_classification(_gp(g), intervals.tile(g, 2048), g.select("chrom", "len"), 120, (4, 4), "g07", _TEST, _VALID, 2048)


@query("g08_peak_regression", v("genome", f"{_GP}, w AS (SELECT DISTINCT chrom, {_win('((\"start\" + \"end\") // 2 - 16 + ' + hs(repr('g08'), 'name') + ' % 33)', 150)} FROM gp JOIN genome USING (chrom)), po AS (SELECT * FROM w WHERE e - s = 150 AND EXISTS (SELECT 1 FROM gp b WHERE b.chrom = w.chrom AND w.s < b.\"end\" AND w.e > b.\"start\")), wn AS (SELECT chrom, count(*) AS n FROM po GROUP BY chrom), " + _NEG.format(L=150, u=hs("'g08'", "chrom", "t::VARCHAR")) + f", al AS (SELECT chrom, s, e, 1 AS label FROM po UNION ALL SELECT chrom, s, e, 0 FROM ng) SELECT chrom, s AS \"start\", e AS \"end\", label, {_SPLIT} FROM al"))
def g08(s, d):
    g = P.genome_written(s, d)
    return datasets.peak_regression(_gp(g), g.select("chrom", "len"), 150, 16, (4, 4), "g08", _TEST, _VALID)


@query("g09_context_extension", v("genome", "SELECT chrom AS id, CASE WHEN length(chrom) % 2 = 0 AND greatest(len // 2 - 100, 0) + 200 <= len THEN substr(seq, greatest(len // 2 - 100, 0) + 1, 200) ELSE seq END AS seq, length(chrom) % 2 = 0 AND greatest(len // 2 - 100, 0) + 200 <= len AS mapped FROM genome"))
def g09(s, d):
    g = P.genome(s, d)
    hits = g.where("length(chrom) % 2 = 0").select(C("chrom").alias("id"), "chrom", F.expr("len div 2").alias("mid"))
    return datasets.extended_context(g.select(C("chrom").alias("id"), "seq"), hits, intervals.tile(g), 200)


@query("g09_unique_mapping")
def g09_unique_mapping(s, d):
    """The middle 150 bases of each contig mapped back to all contigs, every run of 21 a seed. Counting all places of all reads is too slow in SQL; a test does it on small tables."""
    g = P.genome_written(s, d)
    reads = g.select(C("chrom").alias("id"), F.expr("substring(seq, int(len div 2 + 1), 150)").alias("seq"))
    return mapping.map_reads(reads, intervals.tile(g), sample=1, hot=1 << 20, max_edits=0, band=0, contigs=g).select("id", "chrom", "start", "strand", "loci", "unique")


@query("g10_variant_sequences", v("genome", f"{_IV}, rg AS (SELECT *, CASE WHEN name % 2 = 0 THEN '+' ELSE '-' END AS strand FROM iv), vr AS (SELECT chrom, unnest(range(0, len // 150)) * 150 + 70 AS p0, seq FROM genome WHERE len >= 150), vv AS (SELECT chrom, p0, substr(seq, p0 + 1, 1) AS ref, CASE WHEN p0 % 4 = 0 THEN '-' WHEN substr(seq, p0 + 1, 1) = 'C' THEN 'G' ELSE 'C' END AS alt FROM vr), j AS (SELECT rg.chrom, name, p0, strand, substr(seq, \"start\" + 1, \"end\" - \"start\") AS a, substr(seq, \"start\" + 1, p0 - \"start\") || CASE WHEN alt = '-' THEN '' ELSE alt END || substr(seq, p0 + 2, \"end\" - p0 - 1) AS b FROM rg JOIN vv ON vv.chrom = rg.chrom AND p0 >= \"start\" AND p0 + 1 <= \"end\" JOIN genome ON genome.chrom = rg.chrom) SELECT chrom || ':' || name AS name, p0 AS id, md5(CASE WHEN strand = '-' THEN reverse(translate(a, 'ACTGN', 'TGACN')) ELSE a END) AS r, md5(CASE WHEN strand = '-' THEN reverse(translate(b, 'ACTGN', 'TGACN')) ELSE b END) AS a FROM j"))
def g10(s, d):
    g = P.genome_written(s, d)
    n = F.split_part("name", F.lit(":"), F.lit(2)).cast("int")
    rg = _iv(s, d, g).withColumn("strand", F.when(n % 2 == 0, "+").otherwise("-"))
    p = intervals.tile(g, 150).where("length(seq) = 150").select("chrom", "seq", (C("tile_idx") * 150 + 70).alias("p0"))
    ref = F.substring("seq", 71, 1)
    vs = p.select("chrom", (C("p0") + 1).alias("pos"), ref.alias("ref"), F.when(C("p0") % 4 == 0, "-").when(ref == "C", "G").otherwise("C").alias("alt"), C("p0").alias("id"))
    x = datasets.variant_sequences(vs, rg, intervals.tile(g, 2048), 2048)
    return x.select("name", "id", F.md5("ref_seq").alias("r"), F.md5("alt_seq").alias("a"))


@query("gc_content", v("genome", "SELECT chrom, len, round((length(replace(seq, 'A', '')) - length(replace(replace(seq, 'A', ''), 'G', '')) + len - length(replace(seq, 'C', '')))::DOUBLE / nullif(len, 0), 6) AS gc FROM genome"))
def gc_content(s, d):
    return P.genome(s, d).select("chrom", "len", F.round(seq.gc_fraction(C("seq")), 6).alias("gc"))


@query("s22_line_set", "SELECT p_partkey FROM part WHERE p_brand IN (SELECT trim(' ' || p_brand || ' ') FROM part WHERE p_partkey < 4)")
def s22(s, d):
    p = P.table(s, d, "part")
    names = p.where("p_partkey < 4").select(F.trim(F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("p_brand")).distinct()
    return p.join(names, "p_brand", "left_semi").select("p_partkey")


#: Names from when the shorter ones left rows out; both are whole now.
query("g06_promoter_dataset_all", ORACLES["g06_promoter_dataset"])(g06)
query("g10_variant_sequences_all", ORACLES["g10_variant_sequences"])(g10)
