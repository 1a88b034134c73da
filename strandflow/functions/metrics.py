"""Evaluation metrics as grouped aggregates. Labels are 0/1 numbers, scores doubles; undefined ratios are 0 unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.operators import scan

ONE = F.lit


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0.0)))


def confusion(df: DataFrame, y: str, p: str, *keys: str) -> DataFrame:
    """(keys, tp, fp, fn, tn) as doubles, so that products do not overflow."""
    n = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b)).cast("double")
    return df.groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))


def classification(c: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, macro_f1 and mcc beside the counts of confusion()."""
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.withColumns({"accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": f1, "macro_f1": (f1 + f0) / 2, "mcc": _ratio(tp * tn - fp * fn, root)})


def by_score(df: DataFrame, y: str, s: str, *keys: str) -> DataFrame:
    """(keys, s, pos, neg, tp, fp): counts at each different score and cumulated from the highest score down.

    Rows are grouped by score first, so ties share a step; a two-level scan cumulates the different scores, so no key's curve, nor the one of all rows, is one task's."""
    g = df.groupBy(*keys, F.col(s).cast("double").alias("s")).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.sum((F.lit(1) - F.col(y)).cast("double")).alias("neg"))
    return scan.prefix(g, {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, -scan.number_bucket(F.col("s")), (F.desc("s"),), keys)


def auc(df: DataFrame, y: str, s: str, *keys: str, single: float | None = None) -> DataFrame:
    """(keys, auc): area under the ROC curve, ties counted half; `single` (or null) where only one class is present."""
    c = by_score(df, y, s, *keys)
    a = F.sum(F.col("pos") * (F.lit(0.0) - F.col("fp") + F.col("neg") / 2))
    t = c.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), a.alias("a"))
    area = F.lit(1.0) + F.col("a") / (F.nullif(F.col("p"), F.lit(0.0)) * F.nullif(F.col("n"), F.lit(0.0)))
    return t.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), area).otherwise(F.lit(single).cast("double")).alias("auc"))


def average_precision(df: DataFrame, y: str, s: str, *keys: str) -> DataFrame:
    """(keys, ap): sum of recall steps times precision over different scores; 0 without positives."""
    c = by_score(df, y, s, *keys)
    t = c.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("a"))
    return t.select(*keys, _ratio(F.col("a"), F.col("p")).alias("ap"))


_MOMENTS = ("sxx", "syy", "sxy")


def _moments(df: DataFrame, a: Column, b: Column, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Rows where a or b is null do not count. Squares are about the mean, so neither small values nor large means lose their variance."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    n = F.count(a).cast("double")
    centred = [F.coalesce(e * n, F.lit(0.0)).alias(k) for k, e in zip(_MOMENTS, (F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)), strict=True)]
    return df.groupBy(*keys).agg(n.alias("n"), F.coalesce(F.sum(a), F.lit(0.0)).alias("sx"), F.coalesce(F.sum(b), F.lit(0.0)).alias("sy"), *centred, *more)


def sums(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Mergeable sufficient statistics of a correlation: n, sx, sy, and sxx, syy, sxy about the means."""
    return _moments(df, F.col(x), F.col(y), *keys)


def merge_sums(parts: DataFrame, *keys: str) -> DataFrame:
    """The statistics of all parts of a key together: squares within parts and those of the parts' means about the mean of all."""
    whole = parts.groupBy(*keys).agg(*(F.sum(c).alias(f"_{c}") for c in ("n", "sx", "sy")))
    own = F.nullif(F.col("n"), F.lit(0.0))
    dx, dy = (F.coalesce(F.col(c) / own - F.col(f"_{c}") / F.col("_n"), F.lit(0.0)) for c in ("sx", "sy"))
    both = parts.join(whole, list(keys)) if keys else parts.crossJoin(F.broadcast(whole))  # one row
    moved = (F.sum(F.col(k) + F.col("n") * d).alias(k) for k, d in zip(_MOMENTS, (dx * dx, dy * dy, dx * dy), strict=True))
    return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy")), *moved)


def correlation() -> Column:
    """Pearson r of sums(); null where a variance is 0, that is no more than rounding leaves of equal values."""
    varies = lambda s, t: F.col(s) > F.pow(F.col(t) / F.nullif(F.col("n"), F.lit(0.0)), F.lit(2.0)) * F.col("n") * 1e-30
    both = varies("sxx", "sx") & varies("syy", "sy")
    return F.when(both, F.col("sxy") / F.sqrt(F.when(both, F.col("sxx")).otherwise(1.0)) / F.sqrt(F.when(both, F.col("syy")).otherwise(1.0)))


def threshold_at_fpr(df: DataFrame, y: str, s: str, rate: float) -> DataFrame:
    """The last threshold, from the highest score down, before the false-positive rate reaches `rate`."""
    c = by_score(df, y, s)
    n = c.agg(F.sum("neg").alias("n"))
    return c.crossJoin(F.broadcast(n)).where(F.col("fp") / F.nullif(F.col("n"), F.lit(0.0)) < rate).agg(F.min("s").alias("threshold"))  # n is one row


def threshold_at_precision(df: DataFrame, y: str, s: str, precision: float) -> DataFrame:
    """The threshold whose precision is nearest; of equally near ones the highest."""
    c = by_score(df, y, s).withColumn("gap", F.abs(F.col("tp") / (F.col("tp") + F.col("fp")) - precision))
    return c.agg(F.min_by("s", F.struct("gap", -F.col("s"))).alias("threshold"))


def cross_entropy(z0: Column, z1: Column, y: Column) -> Column:
    top = F.greatest(z0, z1)
    return top + F.log(F.exp(z0 - top) + F.exp(z1 - top)) - F.when(y == 1, z1).otherwise(z0)


def weighted_bce(z: Column, y: Column, weight: float = 1.0) -> Column:
    """Binary cross-entropy of a logit, positives weighted."""
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return weight * y * soft(-z) + (F.lit(1.0) - y) * soft(z)


def poisson_nll(rate: Column, target: Column) -> Column:
    return rate - target * F.log(rate + 1e-8)


def masked_mean(x: Column, mask: Column) -> Column:
    return F.coalesce(F.sum(F.when(mask, x)) / F.nullif(F.count_if(mask).cast("double"), F.lit(0.0)), F.lit(0.0))


def masked_pearson(df: DataFrame, x: str, y: str, mask: str, *keys: str) -> DataFrame:
    """(keys, mse, r) over masked rows; r is 0 with under two rows or without variance, mse 0 without rows."""
    m = F.col(mask)
    use = df.select(*keys, F.when(m, F.col(x)).alias("_x"), F.when(m, F.col(y)).alias("_y"))
    gap = F.coalesce(F.avg(F.pow(F.col("_x") - F.col("_y"), F.lit(2.0))), F.lit(0.0)).alias("mse")
    return _moments(use, F.col("_x"), F.col("_y"), *keys, more=(gap,)).select(*keys, "mse", F.coalesce(correlation(), F.lit(0.0)).alias("r"))


def cosine_pearson(a: Column, b: Column) -> Column:
    """Pearson r of two arrays: the cosine of the centred arrays."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)

    def centred(xs: Column) -> Column:
        mean = total(xs) / F.size(xs)
        return F.transform(xs, lambda x: x - mean)

    ca, cb = centred(a), centred(b)
    dot = lambda p, q: total(F.zip_with(p, q, lambda x, y: x * y))
    return dot(ca, cb) / F.nullif(F.sqrt(dot(ca, ca) * dot(cb, cb)), F.lit(0.0))
