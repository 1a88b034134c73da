"""Scalar functions on sequences, text and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.functions import rng, seq

from . import proxies as P
from .registry import ORACLES, query

v, hs = P.with_views, P.hash_sql
C = F.col


@query("f01_revcomp", v("genome", "SELECT chrom, md5(reverse(translate(seq, 'ACTGN', 'TGACN'))) AS rc FROM genome"))
def f01(s, d):
    return P.genome(s, d).select("chrom", F.md5(seq.revcomp(C("seq"))).alias("rc"))


@query("f02_revcomp_iupac", "SELECT doc_id, md5(reverse(translate(text, 'ACGTUMRWSYKVHDBNacgtumrwsykvhdbn', 'TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn'))) AS rc FROM documents")
def f02(s, d):
    return P.table(s, d, "documents").select("doc_id", F.md5(seq.revcomp_iupac(C("text"))).alias("rc"))


_BINS = "list_transform(range(0, (length(seq) + 127) // 128), lambda i: substr(seq, i * 128 + 1, 128))"


@query("f03_revcomp_bins", v("tiles", f"SELECT chrom, tile_idx, array_to_string(list_reverse(list_transform({_BINS}, lambda b: reverse(translate(b, 'ACTGN', 'TGACN')))), '|') AS rc FROM tiles"))
def f03(s, d):
    return P.tiles(s, d).select("chrom", "tile_idx", F.array_join(seq.revcomp_bins(seq.bins(C("seq"), 128)), "|").alias("rc"))


@query("f04_slice", v("genome", "SELECT chrom, substr(seq, 11, 90) AS x FROM genome"))
def f04(s, d):
    return P.genome(s, d).select("chrom", seq.cut(C("seq"), F.lit(10).cast("bigint"), F.lit(100).cast("bigint")).alias("x"))


@query("f05_upper", v("tiles", "SELECT chrom, tile_idx, upper(lower(seq)) AS x FROM tiles"))
def f05(s, d):
    return P.tiles(s, d).select("chrom", "tile_idx", F.upper(F.lower("seq")).alias("x"))


@query("f06_strip_n", v("tiles", "SELECT chrom, tile_idx, ltrim(x, 'N') AS l, trim(x, 'N') AS b FROM (SELECT *, 'NN' || seq || 'N' AS x FROM tiles)"))
def f06(s, d):
    x = F.concat(F.lit("NN"), "seq", F.lit("N"))
    return P.tiles(s, d).select("chrom", "tile_idx", seq.strip_n(x, False).alias("l"), seq.strip_n(x).alias("b"))


@query("f07_one_hot", v("tiles", "x AS (SELECT chrom, tile_idx, unnest(string_split(seq, '')) AS c FROM tiles) SELECT chrom, tile_idx, count(*) FILTER (WHERE c = 'A') AS na, count(*) FILTER (WHERE c = 'C') AS nc, count(*) FILTER (WHERE c = 'G') AS ng, count(*) FILTER (WHERE c = 'T') AS nt, count(*) AS n FROM x GROUP BY chrom, tile_idx"))
def f07(s, d):
    h = P.tiles(s, d).select("chrom", "tile_idx", seq.one_hot(C("seq")).alias("h"))
    n = lambda k: F.size(F.filter("h", lambda r: r[k])).cast("bigint")
    return h.select("chrom", "tile_idx", n(0).alias("na"), n(1).alias("nc"), n(2).alias("ng"), n(3).alias("nt"), F.size("h").cast("bigint").alias("n"))


@query("f08_one_hot_decode", v("tiles", "SELECT chrom, tile_idx, seq AS x FROM tiles"))
def f08(s, d):
    rows = F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c: F.array(*((c == b).cast("int") for b in seq.DECODE_ORDER)))
    return P.tiles(s, d).select("chrom", "tile_idx", seq.one_hot_decode(rows).alias("x"))


@query("f09_bins", v("genome", "x AS (SELECT chrom, unnest(range(0, (len + 127) // 128)) AS i, seq FROM genome) SELECT chrom, i::INT AS bin, substr(seq, i * 128 + 1, 128) AS piece FROM x"))
def f09(s, d):
    return P.genome(s, d).select("chrom", F.posexplode(seq.bins(C("seq"), 128)).alias("bin", "piece"))


@query("f10_bins_from_right", v("genome", "x AS (SELECT chrom, unnest(range(0, (len + 99) // 100)) AS i, reverse(seq) AS r FROM genome) SELECT chrom, i::INT AS bin, reverse(substr(r, i * 100 + 1, 100)) AS piece FROM x"))
def f10(s, d):
    return P.genome(s, d).select("chrom", F.posexplode(seq.bins_from_right(C("seq"), 100)).alias("bin", "piece"))


@query("f12_substitute", v("tiles", "x AS (SELECT chrom, tile_idx, seq, tile_idx % 200 + 1 AS p, tile_idx % 3 + 1 AS n, CASE WHEN tile_idx % 2 = 0 THEN '-' ELSE 'TT' END AS alt FROM tiles) SELECT chrom, tile_idx, substr(seq, 1, least(p, length(seq)) - 1) || CASE WHEN alt = '-' THEN '' ELSE alt END || substr(seq, least(p, length(seq)) + n) AS x FROM x"))
def f12(s, d):
    """Every tile: the place is within it, and what is replaced ends with it at the latest."""
    t = P.tiles(s, d).withColumns({"p": F.least(C("tile_idx") % 200 + 1, F.length("seq").cast("bigint")), "n": C("tile_idx") % 3 + 1, "alt": F.when(C("tile_idx") % 2 == 0, "-").otherwise("TT")})
    return t.select("chrom", "tile_idx", seq.substitute(C("seq"), C("p"), F.substring("seq", C("p").cast("int"), C("n").cast("int")), C("alt")).alias("x"))


@query("f13_allele", v("variants", "SELECT id, CASE WHEN id % 4 = 0 THEN ref WHEN id % 4 = 1 THEN ref WHEN id % 4 = 2 THEN alt ELSE ref || alt END AS a FROM variants"))
def f13(s, d):
    g = F.when(C("id") % 4 == 0, F.lit(-1)).otherwise(C("id") % 4 - 1)
    return P.variants(s, d).select("id", seq.allele(C("ref"), F.array("alt", F.concat("ref", "alt")), g).alias("a"))


@query("f14_gtf_attributes", v("promoters", "SELECT name, name AS gene_id, CASE WHEN strand = '+' THEN 'basic,CCDS' ELSE 'basic' END AS tags FROM promoters"))
def f14(s, d):
    text = F.concat(F.lit('gene_id "'), "name", F.lit('"; tag "basic";'), F.when(C("strand") == "+", ' tag "CCDS";').otherwise(""))
    return P.promoters(s, d).select("name", seq.gtf_attribute(text, "gene_id").alias("gene_id"), F.array_join(seq.gtf_tags(text), ",").alias("tags"))


@query("f15_omim", v("variants", "SELECT id, CASE WHEN id % 3 > 0 THEN array_to_string(list_transform(range(0, id % 3), lambda i: (id + i)::VARCHAR), ',') END AS omim FROM variants"))
def f15(s, d):
    items = F.transform(F.sequence(F.lit(0).cast("bigint"), C("id") % 3), lambda i: F.when(i < C("id") % 3, F.concat(F.lit("OMIM:"), (C("id") + i).cast("string"), F.lit("|x"))).otherwise("MedGen:1"))
    return P.variants(s, d).select("id", F.array_join(seq.omim_ids(items), ",").alias("omim"))


@query("f16_description", v("variants", "SELECT id, 'chrom:' || chrom || ';pos:' || pos AS text, chrom AS c FROM variants"))
def f16(s, d):
    x = P.variants(s, d).select("id", seq.encode_description(F.array(F.struct(F.lit("chrom").alias("k"), C("chrom").alias("v")), F.struct(F.lit("pos").alias("k"), C("pos").cast("string").alias("v")))).alias("text"))
    return x.select("id", "text", seq.decode_description(C("text"))["chrom"].alias("c"))


@query("f17_region", v("peaks", "SELECT name, chrom || ':' || (\"start\" + 1) || '-' || \"end\" AS region FROM peaks"))
def f17(s, d):
    return P.peaks(s, d).select("name", seq.region(C("chrom"), C("start"), C("end")).alias("region"))


@query("f18_mapping", v("peaks", "SELECT name, chrom AS c, strand AS st, \"start\" AS p FROM peaks"))
def f18(s, d):
    c, st, p = seq.parse_mapping(F.concat("chrom", F.lit(":"), "strand", C("start").cast("string")))
    return P.peaks(s, d).select("name", c.alias("c"), st.alias("st"), p.alias("p"))


@query("f19_log_odds", v("pairs", "SELECT grp, count(*) AS n, round(sum(abs((y / 10000 - x) - (x / 7 - y / 9000))), 4) AS total FROM pairs GROUP BY grp"))
def f19(s, d):
    x = seq.log_odds_change(C("x"), C("y") / 10000, C("y") / 9000, C("x") / 7)
    return P.pairs(s, d).groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum(x), 4).alias("total"))


@query("f20_sigmoid_softplus", v("pairs", "SELECT DISTINCT x, round(1 / (1 + exp(-(x - 25))), 6) AS sg, round(greatest(x - 25, 0) + ln(1 + exp(-abs(x - 25))), 6) AS sp FROM pairs"))
def f20(s, d):
    z = C("x") - 25
    return P.pairs(s, d).select("x", F.round(seq.sigmoid(z), 6).alias("sg"), F.round(seq.softplus(z), 6).alias("sp")).distinct()


@query("f21_argmax", "SELECT vec_id, (list_position(embedding, list_aggregate(embedding, 'max')) - 1)::INT AS k FROM embeddings")
def f21(s, d):
    return P.table(s, d, "embeddings").select("vec_id", seq.argmax(C("embedding")).alias("k"))


@query("f22_fold_change", v("pairs", "p AS (SELECT grp, x, sum(y) AS t FROM pairs GROUP BY grp, x) SELECT a.grp, a.x, round(a.t / b.t, 6) AS fc FROM p a JOIN p b ON b.grp = (a.grp + 1) % 50 AND b.x = 51 - a.x"))
def f22(s, d):
    p = P.pairs(s, d).groupBy("grp", "x").agg(F.sum("y").alias("t"))
    b = p.select(((C("grp") + 49) % 50).alias("grp"), (F.lit(51) - C("x")).alias("x"), C("t").alias("t2"))
    return p.join(b, ["grp", "x"]).select("grp", "x", F.round(C("t") / C("t2"), 6).alias("fc"))


@query("f23_l2_sum", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS z FROM embeddings")
def f23(s, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return P.table(s, d, "embeddings").select("vec_id", F.round(total / F.sqrt(square), 5).alias("z"))


@query("f24_relative_bucket", v("variants", "SELECT id, x::BIGINT AS dist, (CASE WHEN x > 0 THEN 16 ELSE 0 END + CASE WHEN abs(x) < 8 THEN abs(x) ELSE least(8 + floor(ln(abs(x)::DOUBLE / 8) / ln(16.0::DOUBLE) * 8)::INT, 15) END)::INT AS b FROM (SELECT id, pos % 601 - 300 AS x FROM variants)"))
def f24(s, d):
    """Distances from variants to the middles of windows of 601 bases."""
    x = P.variants(s, d).select("id", (C("pos") % 601 - 300).alias("dist"))
    return x.select("id", "dist", seq.relative_bucket(C("dist")).alias("b"))


@query("f25_acceptor_axis", v("variants", "SELECT id, x::BIGINT AS dist, (CASE WHEN x BETWEEN -20 AND -1 THEN x - 1 WHEN x = 1 THEN -1 WHEN x BETWEEN 2 AND 20 THEN x - 2 END)::BIGINT AS axis FROM (SELECT id, pos % 51 - 25 AS x FROM variants)"))
def f25(s, d):
    """Distances from variants to the middles of windows of 51 bases."""
    x = P.variants(s, d).select("id", (C("pos") % 51 - 25).alias("dist"))
    return x.select("id", "dist", seq.acceptor_axis(C("dist")).cast("bigint").alias("axis"))


@query("f26_two_decimals", v("pairs", "SELECT DISTINCT x, printf('%.2f', x / 8) AS t FROM pairs"))
def f26(s, d):
    return P.pairs(s, d).select("x").distinct().select("x", seq.two_decimals(C("x") / 8).alias("t"))


@query("f27_sample_list", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def f27(s, d):
    return P.table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("rng_hash", v("genome", f"SELECT chrom, 500 + {hs(repr('corpus'), 'chrom')} % 501 AS k FROM genome"))
def rng_hash(s, d):
    return P.genome(s, d).select("chrom", rng.between(500, 1000, "corpus", C("chrom")).alias("k"))


#: Names from when the shorter ones left rows out; both are whole now.
query("f24_relative_bucket_all", ORACLES["f24_relative_bucket"])(f24)
query("f26_two_decimals_all", ORACLES["f26_two_decimals"])(f26)
