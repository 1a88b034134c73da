"""Aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.operators import ranks as R

from . import proxies as P
from .registry import query

v = P.with_views
C = F.col


@query("a01_group_count", v("peaks", "SELECT chrom, count(*) AS n FROM peaks GROUP BY chrom"))
def a01(s, d):
    return P.peaks(s, d).groupBy("chrom").agg(F.count("*").alias("n"))


@query("a02_value_frequency", v("variants", "SELECT st, count(*) AS n FROM (SELECT unnest(string_split(status, '|')) AS st FROM variants) GROUP BY st"))
def a02(s, d):
    return P.variants(s, d).select(F.explode(F.split("status", r"\|")).alias("st")).groupBy("st").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("a03_counts_with_default", v("variants", "SELECT coalesce(status, '-100') AS st, count(*) AS n FROM variants GROUP BY 1"))
def a03(s, d):
    return P.variants(s, d).groupBy(F.coalesce("status", F.lit("-100")).alias("st")).agg(F.count("*").alias("n"))


@query("a04_max_count_first", v("variants", "SELECT chrom, max(pos) AS top, count(*) AS n, arg_min(ref, id) AS first_ref FROM variants GROUP BY chrom"))
def a04(s, d):
    return P.variants(s, d).groupBy("chrom").agg(F.max("pos").alias("top"), F.count("*").alias("n"), F.min_by("ref", "id").alias("first_ref"))


@query("a05_two_stage", v("pairs", "a AS (SELECT grp, x, max(y) AS q, bool_or(y >= 70000) AS big, count(*) AS n FROM pairs GROUP BY grp, x) SELECT grp, round(max(q), 4) AS q, bool_or(big) AS big, sum(n)::BIGINT AS n FROM a GROUP BY grp"))
def a05(s, d):
    a = P.pairs(s, d).groupBy("grp", "x").agg(F.max("y").alias("q"), F.bool_or(C("y") >= 70000).alias("big"), F.count("*").alias("n"))
    return a.groupBy("grp").agg(F.round(F.max("q"), 4).alias("q"), F.bool_or("big").alias("big"), F.sum("n").alias("n"))


_CT = "SELECT y = 1 AS significant, count(*) FILTER (WHERE s >= 40) AS high, count(*) FILTER (WHERE s < 40) AS low FROM scores GROUP BY 1"


@query("a06_crosstab", v("scores", _CT))
def a06(s, d):
    return P.scores(s, d).groupBy((C("y") == 1).alias("significant")).agg(F.count_if(C("s") >= 40).alias("high"), F.count_if(C("s") < 40).alias("low"))


@query("a07_chi_square", v("scores", "t AS (SELECT count(*) FILTER (WHERE y = 1 AND s >= 40)::DOUBLE a, count(*) FILTER (WHERE y = 1 AND s < 40)::DOUBLE b, count(*) FILTER (WHERE y = 0 AND s >= 40)::DOUBLE c, count(*) FILTER (WHERE y = 0 AND s < 40)::DOUBLE e FROM scores) SELECT round((a + b + c + e) * pow(greatest(abs(a * e - b * c) - (a + b + c + e) / 2, 0), 2) / ((a + b) * (c + e) * (a + c) * (b + e)), 6) AS chi2 FROM t"))
def a07(s, d):
    n = lambda y, hi: F.count_if((C("y") == y) & ((C("s") >= 40) if hi else (C("s") < 40))).cast("double")
    t = P.scores(s, d).agg(n(1, True).alias("a"), n(1, False).alias("b"), n(0, True).alias("c"), n(0, False).alias("e"))
    return t.select(F.round(R.chi_square(C("a"), C("b"), C("c"), C("e")), 6).alias("chi2"))


@query("a08_conditional_rate", v("scores", "SELECT grp, round(sum(y)::DOUBLE / count(*), 6) AS rate FROM scores GROUP BY grp"))
def a08(s, d):
    return P.scores(s, d).groupBy("grp").agg(F.round(F.sum("y").cast("double") / F.count("*"), 6).alias("rate"))


@query("a09_error_by_distance", v("pairs", "a AS (SELECT grp, x, avg(CASE WHEN y < 30000 THEN 1.0::DOUBLE ELSE 0 END) AS e FROM pairs GROUP BY grp, x) SELECT x, round(avg(e), 6) AS mean_error, round(max(e), 6) AS max_error FROM a GROUP BY x"))
def a09(s, d):
    a = P.pairs(s, d).groupBy("grp", "x").agg(F.avg(F.when(C("y") < 30000, 1.0).otherwise(0.0)).alias("e"))
    return a.groupBy("x").agg(F.round(F.avg("e"), 6).alias("mean_error"), F.round(F.max("e"), 6).alias("max_error"))


@query("a10_range_median", v("pairs", "a AS (SELECT grp, avg(y) AS m FROM pairs GROUP BY grp) SELECT CASE WHEN grp < 10 THEN 'DHS' WHEN grp < 35 THEN 'TF' ELSE 'HM' END AS kind, round(median(m), 4) AS m FROM a GROUP BY 1"))
def a10(s, d):
    a = P.pairs(s, d).groupBy("grp").agg(F.avg("y").alias("m"))
    return a.groupBy(F.when(C("grp") < 10, "DHS").when(C("grp") < 35, "TF").otherwise("HM").alias("kind")).agg(F.round(F.median("m"), 4).alias("m"))


@query("a11_masked_mean", v("pairs", "SELECT grp, round(coalesce(sum(y) FILTER (WHERE x > 45) / count(*) FILTER (WHERE x > 45), 0), 2) AS m FROM pairs GROUP BY grp"))
def a11(s, d):
    from strandflow.functions.metrics import masked_mean

    return P.pairs(s, d).groupBy("grp").agg(F.round(masked_mean(C("y"), C("x") > 45), 2).alias("m"))


@query("a12_nan_mean", v("pairs", "SELECT grp, round(avg(CASE WHEN x > 5 THEN y END), 4) AS m FROM pairs GROUP BY grp"))
def a12(s, d):
    z = P.pairs(s, d).withColumn("z", F.when(C("x") > 5, C("y")).otherwise(F.lit(float("nan"))))
    return z.groupBy("grp").agg(F.round(F.avg(F.when(~F.isnan("z"), C("z"))), 4).alias("m"))


@query("a13_split_totals", v("peaks", "SELECT CASE WHEN chrom = 'chr8' THEN 'test' ELSE 'train' END AS split, sum(\"end\" - \"start\")::BIGINT AS bp FROM peaks GROUP BY 1"))
def a13(s, d):
    return P.peaks(s, d).groupBy(F.when(C("chrom") == "chr8", "test").otherwise("train").alias("split")).agg(F.sum(C("end") - C("start")).alias("bp"))


@query("a14_first_any", v("peaks", "SELECT chrom, arg_min(name, (\"start\", \"end\", name)) AS first_name, bool_or(strand = '-') AS any_minus FROM peaks GROUP BY chrom"))
def a14(s, d):
    return P.peaks(s, d).groupBy("chrom").agg(F.min_by("name", F.struct("start", "end", "name")).alias("first_name"), F.bool_or(C("strand") == "-").alias("any_minus"))


@query("w01_percentile_rank", v("pairs", "SELECT grp, x, count(*) AS n, round(min(p), 6) AS p FROM (SELECT grp, x, (rank() OVER (PARTITION BY grp ORDER BY abs(x - 25)) + (count(*) OVER (PARTITION BY grp, abs(x - 25)) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY grp) * 100 AS p FROM pairs) GROUP BY grp, x"))
def w01(s, d):
    p = P.pairs(s, d).withColumn("a", F.abs(C("x") - 25))
    return R.percentile_rank(p, "a", "grp").groupBy("grp", "x").agg(F.count("*").alias("n"), F.round(F.min("percentile"), 6).alias("p"))


@query("w02_running_position", "SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text))::BIGINT AS q FROM conversations")
def w02(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("text").cast("bigint")
    return P.table(s, d, "conversations").select("conv_id", "turn", (F.sum(n).over(w) - n).alias("q"))


@query("w03_islands", v("peaks", 'z AS (SELECT DISTINCT chrom, "start" FROM peaks), y AS (SELECT *, CASE WHEN "start" - lag("start") OVER (PARTITION BY chrom ORDER BY "start") > 100 THEN 1 ELSE 0 END AS new FROM z), x AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS i FROM y) SELECT chrom, i::BIGINT AS island, min("start") AS low, max("start") AS high FROM x GROUP BY 1, 2'))
def w03(s, d):
    w = Window.partitionBy("chrom").orderBy("start")
    y = P.peaks(s, d).select("chrom", "start").distinct().withColumn("new", F.when(C("start") - F.lag("start").over(w) > 100, 1).otherwise(0))
    return y.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("chrom", "island").agg(F.min("start").alias("low"), F.max("start").alias("high"))


@query("w04_lag_lead", v("promoters", 'SELECT name, lag("end") OVER w AS prev_end, lead("start") OVER w AS next_start FROM promoters WINDOW w AS (PARTITION BY chrom ORDER BY "start", name)'))
def w04(s, d):
    w = Window.partitionBy("chrom").orderBy("start", "name")
    return P.promoters(s, d).select("name", F.lag("end").over(w).alias("prev_end"), F.lead("start").over(w).alias("next_start"))


@query("w05_offset_repair", "WITH t AS (SELECT conv_id, turn, turn * 10 AS st, turn * 10 + 8 AS en, length(text) % 5 = 0 AS gap FROM conversations) SELECT conv_id, turn, CASE WHEN gap THEN coalesce(lag(en) OVER (PARTITION BY conv_id ORDER BY turn), st) ELSE st END AS st FROM t")
def w05(s, d):
    t = P.table(s, d, "conversations").select("conv_id", "turn", (C("turn") * 10).alias("st"), (C("turn") * 10 + 8).alias("en"), (F.length("text") % 5 == 0).alias("gap"))
    return R.repair_offsets(t, ("conv_id",), "turn").select("conv_id", "turn", "st")


_FOLD = """c AS (SELECT doc_id, quality AS y, row_number() OVER (ORDER BY doc_id) AS i FROM labels),
k AS (SELECT y, row_number() OVER (ORDER BY min(i)) - 1 AS cls, count(*) AS n FROM c GROUP BY y), s AS (SELECT *, sum(n) OVER (ORDER BY cls) - n AS base FROM k),
a AS (SELECT y, f, (SELECT count(*) FROM range(0, n) r(j) WHERE (base + j) % 5 = f) AS m FROM s, range(0, 5) t(f)), b AS (SELECT y, f, sum(m) OVER (PARTITION BY y ORDER BY f) AS upto, m FROM a),
q AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY doc_id) AS rn FROM labels_), z AS (SELECT doc_id, f + 1 AS fold FROM q JOIN b ON q.y = b.y AND rn <= upto AND rn > upto - m)"""
_FOLD = _FOLD.replace("labels_", "(SELECT doc_id, quality AS y FROM labels)")


@query("w06_stratified_folds", v("", _FOLD + " SELECT doc_id, fold::INT AS fold FROM z"))
def w06(s, d):
    return R.stratified_folds(P.table(s, d, "labels").select("doc_id", C("quality").alias("y")), "y", "doc_id", 5).select("doc_id", "fold")


@query("w07_index_in_group", v("peaks", "SELECT name, row_number() OVER (PARTITION BY chrom, strand ORDER BY name) - 1 AS k FROM peaks"))
def w07(s, d):
    w = Window.partitionBy("chrom", "strand").orderBy("name")
    return P.peaks(s, d).select("name", (F.row_number().over(w) - 1).cast("bigint").alias("k"))


@query("l07_fold_rotation", v("", _FOLD + ", i AS (SELECT unnest(range(0, 5)) AS split) SELECT doc_id, split::INT AS split, CASE ((fold - 1 - split) % 5 + 5) % 5 WHEN 3 THEN 'valid' WHEN 4 THEN 'test' ELSE 'train' END AS role FROM z, i"))
def l07(s, d):
    return R.rotate_folds(w06(s, d), 5)


@query("k12_fold_layout", v("", _FOLD + ", i AS (SELECT unnest(range(0, 5)) AS split), r AS (SELECT split, CASE ((fold - 1 - split) % 5 + 5) % 5 WHEN 3 THEN 'valid' WHEN 4 THEN 'test' ELSE 'train' END AS role FROM z, i) SELECT 'split_' || split || '/' || role AS folder, count(*) AS n FROM r GROUP BY 1"))
def k12(s, d):
    return R.rotate_folds(w06(s, d), 5).groupBy(F.concat(F.lit("split_"), C("split").cast("string"), F.lit("/"), C("role")).alias("folder")).agg(F.count("*").alias("n"))


@query("u01_union_all", v("peaks promoters", "SELECT chrom, \"start\", \"end\" FROM peaks UNION ALL SELECT chrom, \"start\", \"end\" FROM promoters"))
def u01(s, d):
    return P.peaks(s, d).select("chrom", "start", "end").unionByName(P.promoters(s, d).select("chrom", "start", "end"))


@query("u02_labelled_union", v("peaks promoters", "SELECT name, 1 AS label FROM promoters UNION ALL SELECT name, 0 FROM peaks"))
def u02(s, d):
    return P.promoters(s, d).select("name", F.lit(1).alias("label")).unionByName(P.peaks(s, d).select("name", F.lit(0).alias("label")))


@query("u03_both_strands", v("genome", "SELECT chrom, md5(seq) AS digest FROM genome UNION ALL SELECT 'rc_' || chrom, md5(reverse(translate(seq, 'ACTGN', 'TGACN'))) FROM genome"))
def u03(s, d):
    from strandflow.operators import corpus

    return corpus.both_strands(P.genome(s, d)).select("chrom", F.md5("seq").alias("digest"))


@query("u04_named_append", v("peaks", "SELECT 'g_' || chrom || '_test' AS name FROM peaks WHERE chrom = 'chr8' UNION ALL SELECT 'g_' || chrom || '_train' FROM peaks WHERE chrom <> 'chr8'"))
def u04(s, d):
    p = P.peaks(s, d)
    return p.where("chrom = 'chr8'").select(F.concat(F.lit("g_"), "chrom", F.lit("_test")).alias("name")).union(p.where("chrom <> 'chr8'").select(F.concat(F.lit("g_"), "chrom", F.lit("_train")).alias("name")))


@query("u05_index_difference", "SELECT n_nationkey, len(list_filter(range(0, 20), lambda i: i % (n_nationkey % 5 + 2) <> 0))::INT AS n FROM nation")
def u05(s, d):
    every = F.sequence(F.lit(0), F.lit(19))
    return P.table(s, d, "nation").select("n_nationkey", F.size(F.array_except(every, F.filter(every, lambda i: i % (C("n_nationkey") % 5 + 2) == 0))).alias("n"))


@query("u06_distinct_names", v("peaks", "SELECT DISTINCT chrom, strand FROM peaks"))
def u06(s, d):
    return P.peaks(s, d).select("chrom", "strand").distinct()
