"""Bounded samples of labelled rows, for fitting classifiers only; corpus-wide statistics never use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1)).cast("int")


def sample_labels(labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """(doc_id, y) of about `bound` rows at most of labels (all if there are fewer): those whose hashed id is small.

    Rows with a null id or label are left out. The expected size is the bound, whatever the table's size."""
    known = labels.where(usable).select("doc_id", F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    n = known.count()
    if n <= bound:
        return known
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(_STEPS)) < int(_STEPS * bound / n))
