"""Sorting, shuffling, splitting and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.functions import rng
from strandflow.operators import samples as S
from strandflow.operators import scan
from strandflow.operators import windows as W

from . import proxies as P
from .registry import query

v, hs = P.with_views, P.hash_sql
C = F.col


@query("l01_sort_in_chrom", v("promoters", "SELECT chrom, \"start\", name FROM promoters"))
def l01(s, d):
    return P.promoters(s, d).repartition("chrom").sortWithinPartitions("chrom", "start").select("chrom", "start", "name")


@query("l02_head", v("promoters", "SELECT name FROM promoters ORDER BY \"start\", name LIMIT 25"))
def l02(s, d):
    return P.promoters(s, d).orderBy("start", "name").limit(25).select("name")


@query("l03_seeded_shuffle", v("promoters", f"SELECT name, {hs(repr('42'), 'name')} AS draw FROM promoters"))
def l03(s, d):
    return S.shuffle(P.promoters(s, d), "42", C("name")).select("name", "draw")


@query("l04_capped_shuffle", v("peaks", f"SELECT chrom, name FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY {hs(repr('cap'), 'name')}, name) AS k FROM peaks) WHERE k <= 30"))
def l04(s, d):
    return S.cap(P.peaks(s, d), "chrom", 30, "cap", "name").select("chrom", "name")


@query("l05_chromosome_split", v("peaks", "SELECT CASE WHEN chrom IN ('chr8', 'chr9') THEN 'test' WHEN chrom = 'chr10' THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM peaks GROUP BY 1"))
def l05(s, d):
    return S.by_chromosome(P.peaks(s, d), ("chr10",), ("chr8", "chr9")).groupBy("split").agg(F.count("*").alias("n"))


@query("l06_ratio_split", v("peaks", f"x AS (SELECT name, row_number() OVER (ORDER BY {hs(repr('ratio'), 'name')}, name) AS k, count(*) OVER () AS n FROM peaks) SELECT name, CASE WHEN k <= floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'train' END AS part FROM x"))
def l06(s, d):
    return S.ratio_split(P.peaks(s, d), 0.1, "ratio", "name").select("name", "part")


@query("s24_random_test_split", v("scores", f"x AS (SELECT id, row_number() OVER (ORDER BY {hs(repr('hub'), 'id::VARCHAR')}, id) AS k, count(*) OVER () AS n FROM scores) SELECT id, CASE WHEN k <= floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'train' END AS part FROM x"))
def s24(s, d):
    x = P.scores(s, d).withColumn("key", C("id").cast("string"))
    return S.ratio_split(x, 0.1, "hub", "id").select("id", "part")


def _neg(length, tries, per, seed, avoid):
    u = hs(repr(seed), "chrom", "t::VARCHAR")
    return f"""w AS (SELECT chrom, count(*) AS n FROM {avoid} GROUP BY chrom), c AS (SELECT chrom, n, len, unnest(range(1, greatest({tries}, n * {per}) + 1)) AS t FROM w JOIN sizes USING (chrom) WHERE len > {length}),
k AS (SELECT chrom, n, t, {u} % (len - {length} + 1) AS s FROM c), f AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM {avoid} b WHERE b.chrom = k.chrom AND k.s < b."end" AND k.s + {length} > b."start")),
r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY t) AS j FROM f) SELECT chrom, s AS "start", s + {length} AS "end" FROM r WHERE j <= n"""


@query("l08_negatives", v("promoters sizes", _neg(300, 100, 4, "neg", "promoters")))
def l08(s, d):
    p = P.promoters(s, d)
    return W.negatives(p.groupBy("chrom").agg(F.count("*").alias("n")), P.sizes(s, d), p, 300, (100, 4), "neg").select("chrom", "start", "end")


@query("l09_negatives_unchecked", v("promoters sizes", _neg(1000, 200, 6, "neg9", "promoters")))
def l09(s, d):
    p = P.promoters(s, d)
    return W.negatives(p.groupBy("chrom").agg(F.count("*").alias("n")), P.sizes(s, d), p, 1000, (200, 6), "neg9").select("chrom", "start", "end")


_UC = hs(repr("wc"), "i::VARCHAR")


@query("l10_weighted_contigs", v("genome", f"c AS (SELECT chrom, len, sum(len) OVER (ORDER BY chrom ROWS UNBOUNDED PRECEDING) AS upto, sum(len) OVER () AS total FROM genome WHERE len > 0), d AS (SELECT i AS draw, {_UC} AS u FROM (SELECT unnest(range(0, (SELECT 2 * count(*) FROM genome))) AS i)) SELECT draw, chrom FROM d JOIN c ON floor(u::DOUBLE / 4294967296.0::DOUBLE * total) >= upto - len AND floor(u::DOUBLE / 4294967296.0::DOUBLE * total) < upto"))
def l10(s, d):
    """Twice as many draws as there are contigs."""
    g = P.genome(s, d).select("chrom", "len")
    return S.weighted_contigs(g, 2 * g.count(), "wc")


def _chunk(n, length, seed):
    return f"c AS (SELECT chrom, seq, len, unnest(range(0, {n})) AS t FROM genome WHERE len >= {length}), k AS (SELECT chrom, t, {hs(repr(seed), 'chrom', 't::VARCHAR')} % (len - {length} + 1) AS s, seq FROM c), z AS (SELECT chrom, t, s, substr(seq, s + 1, {length}) AS chunk FROM k)"


@query("l11_clean_chunks", v("genome", _chunk(12, 60, "chunk") + ", y AS (SELECT chrom, s, min(t) AS t FROM z WHERE strpos(chunk, 'N') = 0 GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY t) AS k FROM y) SELECT chrom, s AS \"start\" FROM x WHERE k <= 3"))
def l11(s, d):
    return S.clean_chunks(P.genome(s, d), 3, 12, 60, "chunk").select("chrom", "start")


@query("l12_uniform_chunks", v("genome", _chunk(2, 100, "uni") + " SELECT chrom, t AS try, chunk FROM z"))
def l12(s, d):
    return S.uniform_chunks(P.genome(s, d), 2, 100, "uni").select("chrom", "try", "chunk")


@query("l13_suffix_order", "SELECT 'part-' || p_partkey || '.tfr' AS file, row_number() OVER (ORDER BY p_partkey) AS k FROM part")
def l13(s, d):
    f = P.table(s, d, "part").select(F.concat(F.lit("part-"), C("p_partkey").cast("string"), F.lit(".tfr")).alias("file"))
    n = F.regexp_extract("file", r"([0-9]+)\.tfr$", 1).cast("int")
    return scan.position(f, "k", scan.number_bucket(n), (n,)).select("file", "k")


@query("l14_distributed_sampler", v("peaks", "SELECT l_linenumber % 4 AS rank, count(*) AS n FROM lineitem GROUP BY 1"))
def l14(s, d):
    return P.table(s, d, "lineitem").groupBy(S.shard_of(C("l_linenumber"), 4).alias("rank")).agg(F.count("*").alias("n"))


_B = [f"struct_pack(u := {hs(repr('blk'), repr('pick'), 'chrom', repr(str(k)))}, k := {k})" for k in range(20)]


@query("f11_block_shuffle", v("genome", f"g AS (SELECT chrom, substr(seq, 1, len // 20 * 20) AS s FROM genome WHERE len >= 20), p AS (SELECT chrom, s, list_transform(list_sort([{', '.join(_B)}])[1:12], lambda x: x.k) AS picked FROM g), q AS (SELECT *, list_sort(picked) AS places FROM p) SELECT chrom, array_to_string(list_transform(range(0, 20), lambda k: CASE WHEN list_contains(places, k::INT) THEN substr(s, (picked[list_position(places, k::INT)] * (length(s) // 20) + 1)::BIGINT, length(s) // 20) ELSE substr(s, k * (length(s) // 20) + 1, length(s) // 20) END), '') AS x FROM q"))
def f11(s, d):
    g = P.genome(s, d).where("len >= 20").select("chrom", F.substring("seq", F.lit(1), F.expr("int(len div 20 * 20)")).alias("s"))
    return g.select("chrom", S.block_shuffle(C("s"), C("chrom"), "blk").alias("x"))


@query("rng_uniform", v("promoters", f"SELECT count(*) FILTER (WHERE {hs(repr('q'), 'name')} < 2147483648) AS low, count(*) AS n FROM promoters"))
def rng_uniform(s, d):
    return P.promoters(s, d).agg(F.count_if(rng.u("q", C("name")) < 2147483648).alias("low"), F.count("*").alias("n"))
