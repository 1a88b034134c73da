"""Filters, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.functions import seq
from strandflow.operators import variants as V
from strandflow.operators import windows as W

from . import proxies as P
from .registry import query

v, hs = P.with_views, P.hash_sql


@query("p01_contig_filter", v("genome", "SELECT chrom, len FROM genome WHERE len >= 1000 AND NOT contains(chrom, '99')"))
def p01(s, d):
    return P.genome(s, d).where(~F.col("chrom").contains("99") & (F.col("len") >= 1000)).select("chrom", "len")


@query("p02_subcontig_length", v("genome", "b AS (SELECT chrom, len, unnest([0, len // 3]) AS s0, unnest([len // 3, len]) AS e0 FROM genome) SELECT chrom, s0 AS start_pos, e0 AS end_pos FROM b WHERE e0 - s0 >= 400"))
def p02(s, d):
    b = P.genome(s, d).select("chrom", F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.expr("len div 3").alias("b")), F.struct(F.expr("len div 3").alias("a"), F.col("len").alias("b")))).alias("x"))
    return b.where("x.b - x.a >= 400").select("chrom", F.col("x.a").alias("start_pos"), F.col("x.b").alias("end_pos"))


@query("p03_n_fraction", v("genome", "SELECT chrom, round((len - length(replace(seq, 'N', '')))::DOUBLE / len, 6) AS frac FROM genome WHERE len > 0 AND (len - length(replace(seq, 'N', '')))::DOUBLE / len <= 0.01"))
def p03(s, d):
    return P.genome(s, d).where("len > 0").withColumn("f", seq.n_fraction(F.col("seq"))).where("f <= 0.01").select("chrom", F.round("f", 6).alias("frac"))


@query("p04_no_n_exact_length", v("tiles", "SELECT chrom, tile_idx FROM tiles WHERE length(seq) = 256 AND strpos(seq, 'N') = 0"))
def p04(s, d):
    return P.tiles(s, d).where((F.length("seq") == 256) & (F.instr("seq", "N") == 0)).select("chrom", "tile_idx")


@query("p05_review_status", v("variants", "SELECT id FROM variants WHERE status IS NULL OR NOT list_has_any(string_split(status, '|'), ['no_assertion_criteria_provided', 'single_submitter'])"))
def p05(s, d):
    return V.reviewed(P.variants(s, d), ("no_assertion_criteria_provided", "single_submitter")).select("id")


@query("p06_not_null", v("variants", "SELECT id FROM variants WHERE status IS NOT NULL"))
def p06(s, d):
    return P.variants(s, d).where(F.col("status").isNotNull()).select("id")


_MAP = "m(sig, cls) AS (VALUES ('click', 'benign'), ('view', 'none'), ('purchase', 'pathogenic'), ('signup', 'benign'), ('error', 'none'))"


@query("p07_map_and_drop", v("variants", f"{_MAP} SELECT id, cls FROM variants JOIN m USING (sig) WHERE cls <> 'none'"))
def p07(s, d):
    m = s.createDataFrame([("click", "benign"), ("view", "none"), ("purchase", "pathogenic"), ("signup", "benign"), ("error", "none")], "sig string, cls string")
    return V.map_significance(P.variants(s, d), m, strict=False).select("id", "cls")


@query("p08_rename_chrom", v("variants", "x AS (SELECT id, CASE WHEN id % 30 = 0 THEN 'MT' WHEN id % 31 = 0 THEN 'X' WHEN id % 37 = 0 THEN 'GL000' ELSE (id % 22 + 1)::VARCHAR END AS c FROM variants) SELECT id, CASE WHEN c = 'MT' THEN 'chrM' WHEN c = 'GL000' THEN c ELSE 'chr' || c END AS chrom FROM x"))
def p08(s, d):
    i = F.col("id")
    x = P.variants(s, d).select("id", F.when(i % 30 == 0, "MT").when(i % 31 == 0, "X").when(i % 37 == 0, "GL000").otherwise((i % 22 + 1).cast("string")).alias("c"))
    return x.select("id", V.rename_chrom(F.col("c")).alias("chrom"))


@query("p09_normalize_chrom", v("variants", "SELECT id, CASE WHEN starts_with(c, 'chr') THEN c ELSE 'chr' || c END AS chrom FROM (SELECT id, CASE WHEN id % 2 = 0 THEN chrom ELSE substr(chrom, 4) END AS c FROM variants)"))
def p09(s, d):
    return P.variants(s, d).select("id", V.normalize_chrom(F.when(F.col("id") % 2 == 0, F.col("chrom")).otherwise(F.expr("substring(chrom, 4)"))).alias("chrom"))


@query("p10_in_list", v("peaks", "SELECT chrom, name FROM peaks WHERE chrom IN ('chr8', 'chr9', 'chr21')"))
def p10(s, d):
    return P.peaks(s, d).where(F.col("chrom").isin("chr8", "chr9", "chr21")).select("chrom", "name")


@query("p11_snv", v("variants", "SELECT id FROM variants WHERE length(ref) = 1 AND length(alt) = 1"))
def p11(s, d):
    return P.variants(s, d).where(V.is_snv(F.col("ref"), F.col("alt"))).select("id")


@query("p12_feature", v("peaks", "SELECT name FROM peaks WHERE CASE WHEN \"start\" % 3 = 0 THEN 'exon' ELSE 'CDS' END = 'exon'"))
def p12(s, d):
    return P.peaks(s, d).withColumn("feature", F.when(F.col("start") % 3 == 0, "exon").otherwise("CDS")).where("feature = 'exon'").select("name")


@query("p13_score_filter", v("scores", "SELECT id, s FROM scores WHERE s > 0"))
def p13(s, d):
    return P.scores(s, d).where("s > 0").select("id", "s")


@query("p14_peak_centre", v("peaks", "SELECT name, CASE WHEN \"start\" % 4 > 0 THEN \"start\" + \"start\" % 4 ELSE (\"start\" + \"end\") // 2 END AS c FROM peaks"))
def p14(s, d):
    summit = F.when(F.col("start") % 4 > 0, F.col("start") % 4).otherwise(-1)
    return P.peaks(s, d).select("name", W.centre(F.col("start"), F.col("end"), summit).alias("c"))


_CL = "greatest(0, (\"start\" + \"end\") // 2 - 500)"


@query("p15_clamped_window", v("peaks sizes", f"x AS (SELECT name, {_CL} AS s0, CASE WHEN chrom = 'chr3' THEN 900 ELSE len - 140000 END AS len FROM peaks JOIN sizes USING (chrom)), y AS (SELECT name, CASE WHEN s0 + 1001 > len THEN greatest(0, len - 1001) ELSE s0 END AS s1, CASE WHEN s0 + 1001 > len THEN len ELSE s0 + 1001 END AS e1 FROM x) SELECT name, s1, e1 FROM y WHERE e1 - s1 = 1001"))
def p15(s, d):
    p = P.peaks(s, d).join(P.sizes(s, d), "chrom").withColumn("len", F.when(F.col("chrom") == "chr3", 900).otherwise(F.col("len") - 140000))
    a, b = W.clamped(F.floor((F.col("start") + F.col("end")) / 2), 1001, F.col("len"))
    return p.select("name", a.alias("s1"), b.alias("e1")).where("e1 - s1 = 1001")


@query("p16_centred_window", v("peaks sizes", "SELECT name, (\"start\" + \"end\") // 2 - 600 AS s1, (\"start\" + \"end\") // 2 + 600 AS e1 FROM peaks JOIN sizes USING (chrom) WHERE (\"start\" + \"end\") // 2 >= 600 AND (\"start\" + \"end\") // 2 + 600 <= len"))
def p16(s, d):
    a, b = W.centred(F.col("start"), F.col("end"), 1200)
    return P.peaks(s, d).join(P.sizes(s, d), "chrom").select("name", "len", a.alias("s1"), b.alias("e1")).where("s1 >= 0 and e1 <= len").drop("len")


@query("p17_left_clamped", v("peaks", "SELECT name, greatest((\"start\" + \"end\") // 2 - 500, 0) AS s1, greatest((\"start\" + \"end\") // 2 - 500, 0) + 1000 AS e1 FROM peaks"))
def p17(s, d):
    a, b = W.left_clamped(F.floor((F.col("start") + F.col("end")) / 2), 1000)
    return P.peaks(s, d).select("name", a.alias("s1"), b.alias("e1"))


@query("p18_strand_extension", v("promoters", "SELECT name, CASE WHEN strand = '+' THEN \"start\" - 300 ELSE \"start\" - 50 END AS s1, CASE WHEN strand = '+' THEN \"end\" + 50 ELSE \"end\" + 300 END AS e1 FROM promoters"))
def p18(s, d):
    a, b = W.extended(F.col("start"), F.col("end"), F.col("strand"), 300, 50)
    return P.promoters(s, d).select("name", a.alias("s1"), b.alias("e1"))


_U19 = hs("'jit'", "name")


@query("p19_jitter", v("peaks", f"SELECT name, (\"start\" + \"end\") // 2 - 64 + {_U19} % 129 AS c FROM peaks"))
def p19(s, d):
    return P.peaks(s, d).select("name", W.jitter(F.floor((F.col("start") + F.col("end")) / 2), 64, "jit", F.col("name")).alias("c"))


@query("p20_interval_name", v("peaks", "SELECT 'g1_' || chrom || '_' || \"start\" || '_' || \"end\" || CASE WHEN chrom = 'chr8' THEN '_test' ELSE '_train' END AS name FROM peaks"))
def p20(s, d):
    return P.peaks(s, d).select(F.concat_ws("_", F.lit("g1"), "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.when(F.col("chrom") == "chr8", "test").otherwise("train")).alias("name"))


@query("p21_chrom_size", v("genome", "SELECT chrom, len FROM genome WHERE len > 10 * 200 AND len < 1800000000"))
def p21(s, d):
    return P.genome(s, d).where((F.col("len") > 2000) & (F.col("len") < 1_800_000_000)).select("chrom", "len")


@query("p22_pack_columns", v("pairs", "SELECT grp, array_to_string(list_transform([x, y / 1000], lambda z: floor(z)::BIGINT), ',') AS packed FROM pairs"))
def p22(s, d):
    return P.pairs(s, d).select("grp", F.array_join(F.transform(F.array("x", F.col("y") / 1000), lambda z: F.floor(z).cast("string")), ",").alias("packed"))


@query("p23_list_to_ints", v("promoters", "SELECT name, list_transform(list_filter(string_split(\"start\" || ',' || \"end\" || ',', ','), lambda x: x <> ''), lambda x: x::BIGINT)[2] AS x2 FROM promoters"))
def p23(s, d):
    text = F.concat(F.col("start").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit(","))
    return P.promoters(s, d).select("name", F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.cast("bigint"))[1].alias("x2"))


@query("p24_genome_name", v("", "x AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'Anc' || p_partkey WHEN p_partkey % 11 = 0 THEN '_MINIGRAPH_' || p_partkey ELSE 'sp' || p_partkey END AS g FROM part) SELECT g FROM x WHERE NOT contains(g, 'Anc') AND NOT contains(g, '_MINIGRAPH_')"))
def p24(s, d):
    k = F.col("p_partkey")
    g = F.when(k % 7 == 0, F.concat(F.lit("Anc"), k.cast("string"))).when(k % 11 == 0, F.concat(F.lit("_MINIGRAPH_"), k.cast("string"))).otherwise(F.concat(F.lit("sp"), k.cast("string")))
    return P.table(s, d, "part").select(g.alias("g")).where(~F.col("g").contains("Anc") & ~F.col("g").contains("_MINIGRAPH_"))
