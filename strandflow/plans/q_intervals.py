"""Interval algebra and the joins around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.operators import intervals as I
from strandflow.operators import variants as V

from . import proxies as P
from .registry import ORACLES, query

v = P.with_views
C = F.col
_SE = '"start", "end"'
_MEET = 'a."start" < b."end" AND a."end" > b."start"'


@query("j01_interval_overlap", v("peaks promoters", f"SELECT b.name AS gene, count(*) AS n, sum(least(a.\"end\", b.\"end\") - greatest(a.\"start\", b.\"start\"))::BIGINT AS bp FROM peaks a JOIN promoters b ON a.chrom = b.chrom AND {_MEET} GROUP BY b.name"))
def j01(s, d):
    p = P.promoters(s, d)
    return p.join(I.overlap_totals(p, P.peaks(s, d)), ["chrom", "start", "end"]).groupBy(C("name").alias("gene")).agg(F.sum("n").alias("n"), F.sum("bp").alias("bp"))


@query("j02_interval_anti", v("variants promoters", "SELECT id FROM variants a WHERE NOT EXISTS (SELECT 1 FROM promoters b WHERE a.chrom = b.chrom AND a.pos - 1 < b.\"end\" AND a.pos > b.\"start\")"))
def j02(s, d):
    a = P.variants(s, d).select("chrom", (C("pos") - 1).alias("start"), C("pos").alias("end"), "id")
    return I.overlap_join(a, P.promoters(s, d), how="left_anti").select("id")



@query("j03_neighbour_exact", v("peaks promoters", f"SELECT a.name FROM promoters a WHERE EXISTS (SELECT 1 FROM peaks b WHERE a.chrom = b.chrom AND {_MEET})"))
def j03(s, d):
    return I.overlap_join(P.promoters(s, d), P.peaks(s, d), how="left_semi").select("name")


@query("j03_neighbour_compat", v("peaks promoters", """
p AS (SELECT chrom, "start" AS s, max("end") AS e, min("end") AS e0 FROM peaks GROUP BY chrom, "start"),
b AS (SELECT q.name, q."start" AS qs, q."end" AS qe, (SELECT max(struct_pack(s := p.s, e := p.e)) FROM p WHERE p.chrom = q.chrom AND p.s < q."start") AS l,
 (SELECT min(struct_pack(s := p.s, e := p.e0)) FROM p WHERE p.chrom = q.chrom AND p.s >= q."start") AS r FROM promoters q)
SELECT name, coalesce(qs < l.e AND qe > l.s, false) OR coalesce(qs < r.e AND qe > r.s, false) AS near FROM b"""))
def j03c(s, d):
    return I.neighbour_overlap(P.promoters(s, d), P.peaks(s, d)).select("name", "near")


@query("j04_interval_sort", v("peaks", f"SELECT chrom, name, row_number() OVER (PARTITION BY chrom ORDER BY {_SE}, name) AS k FROM peaks"))
def j04(s, d):
    from pyspark.sql import Window

    return P.peaks(s, d).select("chrom", "name", F.row_number().over(Window.partitionBy("chrom").orderBy("start", "end", "name")).cast("bigint").alias("k"))


def merged(gap: int, source: str = "peaks") -> str:
    return f"""z AS (SELECT chrom, {_SE}, max("end") OVER (PARTITION BY chrom ORDER BY {_SE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}),
y AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" - before > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY {_SE} ROWS UNBOUNDED PRECEDING) AS island FROM z),
merged AS (SELECT chrom, min("start") AS "start", max("end") AS "end", count(*) AS n FROM y GROUP BY chrom, island)"""


for _gap in (0, 60):

    @query(f"j05_interval_merge_{_gap}", v("peaks", merged(_gap) + ' SELECT chrom, "start", "end", n FROM merged'))
    def j05(s, d, gap=_gap):
        return I.merge(P.peaks(s, d), gap)


@query("j06_complement", v("peaks sizes", merged(0) + """,
g AS (SELECT chrom, coalesce(lag("end") OVER (PARTITION BY chrom ORDER BY "start"), 0) AS s, "start" AS e FROM merged
UNION ALL SELECT chrom, max("end"), len FROM merged JOIN sizes USING (chrom) GROUP BY chrom, len
UNION ALL SELECT chrom, 0, len FROM sizes WHERE chrom NOT IN (SELECT chrom FROM peaks)) SELECT chrom, s AS "start", e AS "end" FROM g WHERE s < e"""))
def j06(s, d):
    return I.complement(P.peaks(s, d), P.sizes(s, d))


_BLOCKS = """blocks AS (SELECT chrom, (len // 4 * k)::BIGINT AS "start", (len // 4 * k + len // 5)::BIGINT AS "end", 'q' || chrom AS to_chrom, (k * 50000)::BIGINT AS to_start, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS to_strand FROM sizes, range(0, 4) t(k))"""


def blocks(s, d):
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("k")
    b = P.sizes(s, d).select("chrom", "len", k)
    start = F.expr("len div 4 * k")
    return b.select("chrom", start.alias("start"), (start + F.expr("len div 5")).alias("end"), F.concat(F.lit("q"), "chrom").alias("to_chrom"), (C("k") * 50000).alias("to_start"), F.when(C("k") % 2 == 0, "+").otherwise("-").alias("to_strand"))


@query("j07_liftover", v("promoters sizes", _BLOCKS + """, o AS (SELECT a.name, to_chrom, to_strand, to_start, b."start" AS bs, b."end" AS be, greatest(a."start", b."start") AS lo, least(a."end", b."end") AS hi FROM promoters a JOIN blocks b ON a.chrom = b.chrom AND a."start" < b."end" AND a."end" > b."start")
SELECT name, to_chrom AS chrom, CASE WHEN to_strand = '+' THEN to_start + lo - bs ELSE to_start + be - hi END AS "start", CASE WHEN to_strand = '+' THEN to_start + hi - bs ELSE to_start + be - lo END AS "end", to_strand AS strand FROM o"""))
def j07(s, d):
    return I.liftover(P.promoters(s, d), blocks(s, d))


_IV = "iv AS (SELECT chrom, i AS name, i * 301 AS \"start\", least(i * 301 + 400, len) AS \"end\" FROM (SELECT *, unnest(range(0, len // 301)) AS i FROM genome))"


def _iv(s, d, genome=None):
    g = (P.genome(s, d) if genome is None else genome).where("len >= 301").select("chrom", "len", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("len div 301 - 1"))).alias("i"))
    return g.select("chrom", F.concat_ws(":", "chrom", C("i").cast("string")).alias("name"), (C("i") * 301).alias("start"), F.least(C("i") * 301 + 400, C("len")).alias("end"))


@query("j08_getfasta", v("genome", f"{_IV} SELECT iv.chrom || ':' || name AS name, substr(seq, \"start\" + 1, \"end\" - \"start\") AS sequence FROM iv JOIN genome USING (chrom)"))
def j08(s, d):
    return I.get_fasta(_iv(s, d), P.tiles(s, d)).select("name", "sequence")


@query("s03_indexed_fetch", ORACLES["j08_getfasta"])
def s03(s, d):
    """The same regions asked for as strings, contig:first-last."""
    r = _iv(s, d).select("name", F.concat("chrom", F.lit(":"), (C("start") + 1).cast("string"), F.lit("-"), C("end").cast("string")).alias("region"))
    return I.fetch_regions(r, P.tiles(s, d)).select("name", "sequence")


@query("j09_faidx", v("genome", "SELECT chrom, len FROM genome"))
def j09(s, d):
    return P.genome(s, d).select("chrom", "len")


@query("j10_length_sum", v("peaks", merged(10000) + """ SELECT chrom, b.bp AS bp_before, a.bp AS bp_after, a.n AS n FROM (SELECT chrom, sum("end" - "start")::BIGINT AS bp FROM peaks GROUP BY chrom) b JOIN (SELECT chrom, sum("end" - "start")::BIGINT AS bp, count(*) AS n FROM merged GROUP BY chrom) a USING (chrom)"""))
def j10(s, d):
    b = I.length_sum(P.peaks(s, d), "chrom").select("chrom", C("bp").alias("bp_before"))
    return b.join(I.length_sum(I.merge(P.peaks(s, d), 10000), "chrom").select("chrom", C("bp").alias("bp_after"), "n"), "chrom")


@query("j11_stitch", v("genome", "SELECT chrom, md5(seq) AS digest FROM genome WHERE len > 0"))
def j11(s, d):
    return I.stitch(P.tiles(s, d)).select("chrom", F.md5("seq").alias("digest"))


@query("j12_signal_mean", v("promoters signal", f"SELECT a.name, round(coalesce(sum(b.value * (least(a.\"end\", b.\"end\") - greatest(a.\"start\", b.\"start\"))), 0) / (a.\"end\" - a.\"start\"), 6) AS m FROM promoters a LEFT JOIN signal b ON a.chrom = b.chrom AND {_MEET} GROUP BY a.name, a.\"start\", a.\"end\""))
def j12(s, d):
    return I.span_mean(P.promoters(s, d), P.signal(s, d)).select("name", F.round("mean", 6).alias("m"))


@query("s12_signal_range", v("signal", "SELECT chrom, \"start\", coalesce(value, 0) AS value FROM signal WHERE chrom = 'chr7' AND \"start\" < 2000 AND \"end\" > 500"))
def s12(s, d):
    return P.signal(s, d).where("chrom = 'chr7' and start < 2000 and end > 500").select("chrom", "start", F.coalesce("value", F.lit(0.0)).alias("value"))


_TOK = "tok AS (SELECT conv_id AS sample, turn AS pos, length(text)::BIGINT AS length FROM conversations)"


def _tok(s, d):
    return P.table(s, d, "conversations").select(C("conv_id").alias("sample"), C("turn").alias("pos"), F.length("text").cast("bigint").alias("length"))


@query("j13_token_coordinates", v("", _TOK + ", r AS (SELECT *, sum(length) OVER (PARTITION BY sample ORDER BY pos ROWS UNBOUNDED PRECEDING) AS done FROM tok) SELECT sample, pos, (CASE WHEN sample % 2 = 0 THEN 1000 + done - length ELSE 90000 - done END)::BIGINT AS tok_start, (CASE WHEN sample % 2 = 0 THEN 1000 + done ELSE 90000 - done + length END)::BIGINT AS tok_end FROM r"))
def j13(s, d):
    t = I.token_coordinates(_tok(s, d), F.lit(1000).cast("bigint"), F.lit(90000).cast("bigint"), F.when(C("sample") % 2 == 0, "+").otherwise("-"))
    return t.select("sample", "pos", "tok_start", "tok_end")


_GT = "gt AS (SELECT id, 's' || k AS sample, CASE WHEN (id + k) % 9 = 0 THEN -1 ELSE (id * k) % 3 - (id * k) % 3 // 2 END AS a1 FROM variants, range(1, 4) t(k))"


@query("j14_window_variants", v("promoters variants", _GT + " SELECT p.name, sample, count(*) AS n FROM promoters p JOIN variants v ON p.chrom = v.chrom AND v.pos - 1 < p.\"end\" AND v.pos > p.\"start\" JOIN gt ON gt.id = v.id WHERE a1 > 0 GROUP BY 1, 2"))
def j14(s, d):
    vs = P.variants(s, d).select("chrom", (C("pos") - 1).alias("start"), C("pos").alias("end"), "id")
    calls = vs.join(genotypes(s, d).where("a1 > 0"), "id").select("chrom", "sample", "start", "end")
    p = P.promoters(s, d)
    asked = p.select("chrom", "start", "end").distinct().join(calls.select("chrom", "sample").distinct(), "chrom")
    found = I.overlap_totals(asked, calls, ("chrom", "sample"))
    return p.join(found, ["chrom", "start", "end"]).groupBy("name", "sample").agg(F.sum("n").alias("n"))


def genotypes(s, d):
    k = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("k")
    m = C("id") * C("k") % 3
    return P.variants(s, d).select("id", k).select("id", F.concat(F.lit("s"), C("k").cast("string")).alias("sample"), F.when((C("id") + C("k")) % 9 == 0, -1).otherwise(m - F.floor(m / 2)).alias("a1"))


@query("g04_sample_mask", v("variants", _GT + " SELECT chrom, sample FROM gt JOIN variants USING (id) GROUP BY 1, 2 HAVING bool_or(a1 > 0)"))
def g04(s, d):
    return V.used_samples(genotypes(s, d).join(P.variants(s, d).select("id", "chrom"), "id"), ("chrom", "sample"))


@query("j20_equi_join", v("variants", "SELECT id, n_name FROM variants JOIN nation ON id % 25 = n_nationkey"))
def j20(s, d):
    return P.variants(s, d).join(F.broadcast(P.table(s, d, "nation")), C("id") % 25 == C("n_nationkey")).select("id", "n_name")  # 25 rows by definition


@query("j21_semi_join", v("variants", "SELECT id FROM variants WHERE chrom IN (SELECT DISTINCT 'chr' || n_nationkey FROM nation WHERE n_regionkey = 1)"))
def j21(s, d):
    names = P.table(s, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("chr"), C("n_nationkey").cast("string")).alias("chrom"))
    return P.variants(s, d).join(names, "chrom", "left_semi").select("id")


@query("j23_offset_join", v("variants", "SELECT a.id, b.event_type AS kind FROM variants a JOIN events b ON b.event_id = (a.id // 256) * 256 + a.id % 7"))
def j23(s, d):
    e = P.table(s, d, "events").select("event_id", C("event_type").alias("kind"))
    return P.variants(s, d).select("id", (F.floor(C("id") / 256) * 256 + C("id") % 7).alias("event_id")).join(e, "event_id").select("id", "kind")


@query("j24_contig_lookup", v("peaks sizes", "SELECT name, len FROM peaks JOIN sizes USING (chrom)"))
def j24(s, d):
    j = P.peaks(s, d).join(P.sizes(s, d), "chrom", "left")
    return j.select("name", F.when(C("len").isNull(), F.raise_error(F.concat(F.lit("unknown contig "), "chrom")).cast("bigint")).otherwise(C("len")).alias("len"))


@query("j25_ref_alt_pairing", v("variants", "SELECT a.id, (b.pos - a.pos)::BIGINT AS delta FROM variants a JOIN variants b ON b.id = a.id + 1 WHERE a.id % 2 = 0"))
def j25(s, d):
    x = P.variants(s, d).select("id", "pos")
    return x.where("id % 2 = 0").join(x.select((C("id") - 1).alias("id"), C("pos").alias("p2")), "id").select("id", (C("p2") - C("pos")).alias("delta"))


@query("j26_mutation_grid", v("promoters", "SELECT name, dist, alt FROM promoters, (SELECT unnest(range(-20, 21)) AS dist) g, (SELECT unnest(['A', 'C', 'G']) AS alt) h WHERE dist <> 0"))
def j26(s, d):
    dist = F.explode(F.array(*(F.lit(k).cast("bigint") for k in range(-20, 21) if k))).alias("dist")
    return P.promoters(s, d).select("name", dist).select("name", "dist", F.explode(F.array(*map(F.lit, "ACG"))).alias("alt"))


@query("j27_species_files", "SELECT n_name AS genome, r_name || '/' || n_name || '.fa' AS file FROM nation JOIN region ON n_regionkey = r_regionkey")
def j27(s, d):
    return P.table(s, d, "nation").join(P.table(s, d, "region"), C("n_regionkey") == C("r_regionkey")).select(C("n_name").alias("genome"), F.concat("r_name", F.lit("/"), "n_name", F.lit(".fa")).alias("file"))
