"""Metric aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.functions import metrics as M

from . import proxies as P
from .registry import query

v = P.with_views
C = F.col


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_CONF = """c AS (SELECT grp, count(*) FILTER (WHERE y = 1 AND s >= 40)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND s >= 40)::DOUBLE AS fp,
count(*) FILTER (WHERE y = 1 AND s < 40)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND s < 40)::DOUBLE AS tn FROM scores GROUP BY grp)"""


def _conf(s, d):
    return M.confusion(P.scores(s, d).withColumn("p", (C("s") >= 40).cast("int")), "y", "p", "grp")


@query("m01_classification", v("scores", _CONF + """ SELECT grp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
round((CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END + CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2 * tn / (2 * tn + fp + fn) END) / 2, 6) AS macro_f1 FROM c"""))
def m01(s, d):
    k = ("accuracy", "precision", "recall", "f1", "macro_f1")
    return r6(M.classification(_conf(s, d)).select("grp", *k), *k)


@query("m02_matthews", v("scores", _CONF + " SELECT grp, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM c"))
def m02(s, d):
    return r6(M.classification(_conf(s, d)).select("grp", "mcc"), "mcc")


@query("m13_confusion", v("scores", _CONF + " SELECT * FROM c"))
def m13(s, d):
    return _conf(s, d)


def _auc_sql(keys: str, single: str = "NULL") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    pick = f"{keys}, " if keys else ""
    return f"""r AS (SELECT {pick}y, rank() OVER ({part}ORDER BY s) + (count(*) OVER (PARTITION BY {pick}s) - 1) / 2.0::DOUBLE AS k FROM scores),
t AS (SELECT {pick}sum(CASE WHEN y = 1 THEN k END) AS kp, sum(y)::DOUBLE AS p, (count(*) - sum(y))::DOUBLE AS n FROM r {group})
SELECT {pick}round(CASE WHEN p > 0 AND n > 0 THEN (kp - p * (p + 1) / 2) / (p * n) ELSE {single} END, 6) AS auc FROM t"""


@query("m03_roc_auc", v("scores", _auc_sql("")))
def m03(s, d):
    return r6(M.auc(P.scores(s, d), "y", "s"), "auc")


@query("m04_class_auc", v("scores", _auc_sql("grp", "0.5")))
def m04(s, d):
    return r6(M.auc(P.scores(s, d), "y", "s", "grp", single=0.5), "auc")


_AP = """g AS (SELECT {k}s, sum(y)::DOUBLE AS pos, (count(*) - sum(y))::DOUBLE AS neg FROM {t} GROUP BY {k}s),
h AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS ({p}ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


def _ap(keys: str = "", t: str = "scores") -> str:
    return _AP.format(k=f"{keys}, " if keys else "", p=f"PARTITION BY {keys} " if keys else "", t=t)


@query("m05_average_precision", v("scores", _ap("grp") + " SELECT grp, round(CASE WHEN sum(pos) = 0 THEN 0 ELSE sum(pos * tp / (tp + fp)) / sum(pos) END, 6) AS ap FROM h GROUP BY grp"))
def m05(s, d):
    return r6(M.average_precision(P.scores(s, d), "y", "s", "grp"), "ap")


_R = "(sum(x * y) - sum(x) * sum(y) / count(*)) / sqrt((sum(x * x) - sum(x) * sum(x) / count(*)) * (sum(y * y) - sum(y) * sum(y) / count(*)))"


@query("m06_pearson", v("pairs", f"SELECT grp, round({_R}, 5) AS r, round(({_R}) * ({_R}), 5) AS r2 FROM pairs GROUP BY grp"))
def m06(s, d):
    return M.sums(P.pairs(s, d), "x", "y", "grp").select("grp", F.round(M.correlation(), 5).alias("r"), F.round(M.correlation() * M.correlation(), 5).alias("r2"))


@query("m07_merged_pearson", v("pairs", f"SELECT grp, round({_R}, 5) AS r FROM pairs GROUP BY grp"))
def m07(s, d):
    p = P.pairs(s, d).withColumn("part", F.floor(C("x")).cast("int") % 4)
    return M.merge_sums(M.sums(p, "x", "y", "grp", "part"), "grp").select("grp", F.round(M.correlation(), 5).alias("r"))


_CH = f"ch AS (SELECT grp, CASE WHEN grp = 3 THEN NULL ELSE {_R} END AS r FROM pairs GROUP BY grp)"


@query("m08_mean_pearson", v("pairs", _CH + " SELECT round(avg(r), 5) AS skipping, CASE WHEN count(*) = count(r) THEN round(avg(r), 5) END AS strict FROM ch"))
def m08(s, d):
    p = P.pairs(s, d).withColumn("x", F.when(C("grp") == 3, F.lit(1.0)).otherwise(C("x")))
    c = M.sums(p, "x", "y", "grp").select(M.correlation().alias("r"))
    return c.agg(F.round(F.avg("r"), 5).alias("skipping"), F.when(F.count("*") == F.count("r"), F.round(F.avg("r"), 5)).alias("strict"))


@query("m09_masked", v("pairs", f"m AS (SELECT grp, x, y / 1000 AS y FROM pairs WHERE x > 20) SELECT grp, round(avg((x - y) * (x - y)), 4) AS mse, round({_R}, 5) AS r FROM m GROUP BY grp"))
def m09(s, d):
    p = P.pairs(s, d).withColumn("y", C("y") / 1000).withColumn("m", C("x") > 20)
    return M.masked_pearson(p, "x", "y", "m", "grp").select("grp", F.round("mse", 4).alias("mse"), F.round("r", 5).alias("r"))


@query("m10_report", v("scores", _ap("grp") + " SELECT grp, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * tp / (tp + fp)) / sum(pos), 6) END AS pr_auc, sum(pos + neg)::BIGINT AS n FROM h GROUP BY grp"))
def m10(s, d):
    x = P.scores(s, d)
    n = x.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("y").alias("k"))
    return M.average_precision(x, "y", "s", "grp").join(n, "grp").select("grp", F.when(C("k") == 2, F.round("ap", 6)).alias("pr_auc"), "n")


@query("m11_fpr_threshold", v("scores", _ap() + " SELECT min(s) AS threshold FROM h WHERE fp / (SELECT sum(neg) FROM g) < 0.2"))
def m11(s, d):
    return M.threshold_at_fpr(P.scores(s, d), "y", "s", 0.2)


@query("m12_precision_threshold", v("scores", _ap() + " SELECT s AS threshold FROM h ORDER BY abs(tp / (tp + fp) - 0.9), s DESC LIMIT 1"))
def m12(s, d):
    return M.threshold_at_precision(P.scores(s, d), "y", "s", 0.9)


@query("m14_segment_ap", v("scores", "z AS (SELECT id % 4 AS seg, y, s FROM scores WHERE id % 5 <> 0), " + _ap("seg", "z") + " SELECT seg, round(CASE WHEN sum(pos) = 0 THEN 0 ELSE sum(pos * tp / (tp + fp)) / sum(pos) END, 6) AS ap, sum(pos)::BIGINT AS positives FROM h GROUP BY seg"))
def m14(s, d):
    z = P.scores(s, d).where("id % 5 <> 0").withColumn("seg", C("id") % 4)
    p = z.groupBy("seg").agg(F.sum("y").alias("positives"))
    return r6(M.average_precision(z, "y", "s", "seg"), "ap").join(p, "seg")


@query("m15_augmentation_mean", v("", f"a AS (SELECT l_suppkey % 50 AS grp, l_linenumber AS bin, avg(l_quantity) AS x, avg(l_discount * 100) AS y FROM lineitem GROUP BY 1, 2), b AS (SELECT grp, x, y FROM a) SELECT grp, round({_R}, 5) AS r FROM b GROUP BY grp"))
def m15(s, d):
    li = P.table(s, d, "lineitem").select((C("l_suppkey") % 50).alias("grp"), C("l_linenumber").alias("bin"), "l_quantity", (C("l_discount") * 100).alias("t"))
    a = li.groupBy("grp", "bin").agg(F.avg("l_quantity").alias("x"), F.avg("t").alias("y"))
    return M.sums(a, "x", "y", "grp").select("grp", F.round(M.correlation(), 5).alias("r"))


@query("m16_cosine_pearson", "WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(list_reverse(embedding))::DOUBLE AS y FROM embeddings) SELECT vec_id, round(" + _R + ", 5) AS r FROM a GROUP BY vec_id")
def m16(s, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return P.table(s, d, "embeddings").select("vec_id", e.alias("e")).select("vec_id", F.round(M.cosine_pearson(C("e"), F.reverse("e")), 5).alias("r"))


@query("m17_losses", v("scores", """q AS (SELECT y::DOUBLE AS y, s / 20 AS z FROM scores) SELECT round(avg((z - y) * (z - y)), 6) AS mse, round(avg(ln(exp(0.0::DOUBLE) + exp(z - 2)) - CASE WHEN y = 1 THEN z - 2 ELSE 0 END), 6) AS ce,
round(avg(8 * y * ln(1 + exp(-(z - 2))) + (1 - y) * ln(1 + exp(z - 2))), 6) AS bce, round(avg((z + 1) - y * ln(z + 1 + 1e-8)), 6) AS poisson, round(avg(CASE WHEN z > 1 THEN z END), 6) AS masked FROM q"""))
def m17(s, d):
    q = P.scores(s, d).select(C("y").cast("double").alias("y"), (C("s") / 20).alias("z"))
    y, z = C("y"), C("z")
    return q.agg(F.round(F.avg((z - y) * (z - y)), 6).alias("mse"), F.round(F.avg(M.cross_entropy(F.lit(0.0), z - 2, y)), 6).alias("ce"), F.round(F.avg(M.weighted_bce(z - 2, y, 8.0)), 6).alias("bce"), F.round(F.avg(M.poisson_nll(z + 1, y)), 6).alias("poisson"), F.round(M.masked_mean(z, z > 1), 6).alias("masked"))


@query("n05_masked_head", v("pairs", "SELECT grp, count(*) AS n, round(sum(greatest(x - 25, 0) + ln(1 + exp(-abs(x - 25)))), 5) AS total FROM pairs WHERE x > 10 GROUP BY grp"))
def n05(s, d):
    from strandflow.functions import seq

    return P.pairs(s, d).where("x > 10").groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum(seq.softplus(C("x") - 25)), 5).alias("total"))


@query("m18_centroid_cosine", "WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY 1, 2) SELECT e.label, round(avg(cs), 6) AS cohesion FROM (SELECT e.label, e.vec_id, sum(x * c) / sqrt(sum(x * x) * sum(c * c)) AS cs FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY 1, 2) e GROUP BY e.label")
def m18(s, d):
    e = P.table(s, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", C("x").cast("double"))
    c = e.groupBy("label", "i").agg(F.avg("x").alias("c"))
    per = e.join(c, ["label", "i"]).groupBy("label", "vec_id").agg((F.sum(C("x") * C("c")) / F.sqrt(F.sum(C("x") * C("x")) * F.sum(C("c") * C("c")))).alias("cs"))
    return per.groupBy("label").agg(F.round(F.avg("cs"), 6).alias("cohesion"))


@query("n07_attribution", "SELECT vec_id, round(list_sum(a), 4) AS total, round(list_sum(a) / sqrt(list_sum(list_transform(a, lambda x: x * x))), 5) AS z, 0.0::DOUBLE AS missed FROM (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda k: k * embedding[k]::DOUBLE * embedding[k]::DOUBLE) AS a FROM embeddings)")
def n07(s, d):
    """Attributions of a stand-in model whose path integrals are known, summed and normalised as f23 does."""
    from strandflow.functions import attribution

    a = attribution.attribute(P.table(s, d, "embeddings"), "strandflow.functions.attribution:quadratic", "vec_id", "embedding", tolerance=1e-6)
    total = F.aggregate("attribution", F.lit(0.0), lambda t, x: t + x)
    square = F.aggregate("attribution", F.lit(0.0), lambda t, x: t + x * x)
    return a.select("vec_id", F.round(total, 4).alias("total"), F.round(total / F.sqrt(square), 5).alias("z"), F.abs(F.round("delta", 6)).alias("missed"))


@query("m18_components")
def m18_components(s, d):
    """Coordinates of all embeddings along their first two principal components. An eigenproblem has no SQL form; a test compares with a whole decomposition."""
    from strandflow.operators import reduction

    e = P.table(s, d, "embeddings")
    return reduction.project(e, "vec_id", "embedding", reduction.fit(e, "embedding", 2)).select("vec_id", F.round(C("projection")[0], 5).alias("x"), F.round(C("projection")[1], 5).alias("y"))
