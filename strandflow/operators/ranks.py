"""Ranks, folds and small statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def percentile_rank(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """df with `percentile`: the tie-averaged rank of value in its group, in percent of the group's rows.

    Ranks are of the different values of a group, so equal values cost one row, and a two-level scan ranks them, so a group may be of any size."""
    g = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    r = scan.prefix(g, {"_upto": ("sum", F.col("_n"))}, scan.number_bucket(F.col(value)), (F.col(value),), keys)
    total = g.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    r = r.join(total, list(keys)) if keys else r.crossJoin(F.broadcast(total))  # one row
    r = r.withColumn("percentile", (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)) / F.col("_all") * 100).drop("_n", "_upto", "_all")
    return df.join(r, [*keys, value])


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a 2 x 2 table with Yates' correction; null where a margin is 0."""
    n = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return n * gap * gap / F.nullif((a + b) * (c + d) * (a + c) * (b + d), F.lit(0.0))


def repair_offsets(tokens: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Tokens marked `gap` start where the token before them ends."""
    before = F.lag("en").over(Window.partitionBy(*keys).orderBy(order))
    return tokens.withColumn("st", F.when(F.col("gap"), F.coalesce(before, F.col("st"))).otherwise(F.col("st")))


def stratified_folds(df: DataFrame, label: str, order: str, folds: int = 5) -> DataFrame:
    """df with `fold` from 1: contiguous blocks of each class in row order, as large as striding the class-sorted labels gives.

    Classes are numbered by first appearance. Only class sizes are sorted together; ranks within a class, by a number, come from a two-level scan."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    base = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1))  # a row for each class
    s = sizes.withColumn("base", F.coalesce(base, F.lit(0).cast("bigint")))
    below = lambda x, f: F.floor((x + folds - 1 - f) / F.lit(folds))  # numbers under x that are f modulo folds
    alloc = F.array(*(below(F.col("base") + F.col("n"), f) - below(F.col("base"), f) for f in range(folds)))
    ends = F.transform(F.sequence(F.lit(1), F.lit(folds)), lambda k: F.aggregate(F.slice("alloc", 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x))
    s = s.withColumn("alloc", alloc).withColumn("ends", ends).select(label, "ends")
    ranked = scan.position(df, "_r", scan.number_bucket(F.col(order)), (F.col(order),), (label,))
    return ranked.join(s, label).withColumn("fold", (F.size(F.filter("ends", lambda e: e < F.col("_r"))) + 1).cast("int")).drop("_r", "ends")


def rotate_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, split, role) for each split: folds rotated by the split's number, the last two valid and test."""
    s = df.withColumn("split", F.explode(F.array(*map(F.lit, range(folds)))))
    at = F.pmod(F.col("fold") - 1 - F.col("split"), F.lit(folds))
    role = F.when(at == folds - 2, "valid").when(at == folds - 1, "test").otherwise("train")
    return s.select("doc_id", "split", role.alias("role"))
