"""Running aggregates over an order that no single task can hold: two-level prefix scans.

Rows are cut into buckets that ascend with the order. A bucket's rows are scanned by one task, buckets' totals are scanned apart, and what lies before a
bucket is joined back to its rows. So a key with few values, or none, does not put its rows into one task; a key's buckets are as many as the bucket column has values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGGREGATES = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least)}
OCTAVE = 4096  # buckets of numbers between a power of two and the next


def prefix(df: DataFrame, columns: dict[str, tuple[str, Column]], bucket: Column, order: tuple[Column, ...], keys: tuple[str, ...] = (), inclusive: bool = True) -> DataFrame:
    """df with running aggregates: `columns` gives each new name its kind (sum, max or min) and what it runs over.

    `bucket` ascends with `order` within keys, ties in it are no matter; equal places in `order` are taken in any order. Exclusive scans are null (sum: 0) at the first row. Null keys
    are a key, null values do not count."""
    names = [*keys, "_bucket"]
    given = df.withColumns({"_bucket": bucket, **{f"_v{k}": value for k, (_, value) in enumerate(columns.values())}})
    rows = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    kinds = [_AGGREGATES[kind] for kind, _ in columns.values()]
    totals = given.groupBy(*names).agg(*(f(f"_v{k}").alias(f"_t{k}") for k, (f, _) in enumerate(kinds)))
    # a row for each bucket of a key
    before = totals.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(names)), *(f(f"_t{k}").over(earlier).alias(f"_b{k}") for k, (f, _) in enumerate(kinds)))
    local = given.withColumns({f"_s{k}": f(f"_v{k}").over(rows) for k, (f, _) in enumerate(kinds)})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(names)))
    both = local.join(before, same)
    out = []
    for k, (name, (kind, _)) in enumerate(columns.items()):
        a, b = F.col(f"_b{k}"), F.col(f"_s{k}")
        joint = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(kinds[k][1](a, b))
        out.append((F.coalesce(joint, F.lit(0)) if kind == "sum" else joint).alias(name))
    return both.select(*[c for c in df.columns if c not in columns], *out)


def position(df: DataFrame, name: str, bucket: Column, order: tuple[Column, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """df with `name`: the place of each row in its key's order, from 1."""
    return prefix(df, {name: ("sum", F.lit(1).cast("bigint"))}, bucket, order, keys)


def number_bucket(x: Column, octave: int = OCTAVE) -> Column:
    """A bucket for any number, ascending with it: `octave` of them between a power of two and the next. Equal numbers share one; NaN comes last, as it sorts."""
    size = F.abs(x.cast("double"))
    exponent = F.floor(F.log2(size))
    # at a power of two the logarithm may round to either side; both give the same bucket
    own = (exponent + 1100) * octave + F.floor(size / F.pow(F.lit(2.0), exponent.cast("double")) * octave)
    far = F.lit(1 << 40)
    one = F.when(size == 0, 0).when(F.isnan(size), far + 1).when(size == float("inf"), far).otherwise(own).cast("bigint")
    return F.when(x < 0, -one).otherwise(one)


def whole_bucket(x: Column, size: int = 1 << 16) -> Column:
    """Buckets of `size` consecutive whole numbers."""
    return F.floor(x / F.lit(size))
