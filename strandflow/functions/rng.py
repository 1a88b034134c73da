"""Deterministic hash randomness: the same numbers in every engine, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u(*keys: Column | str | int) -> Column:
    """A number in [0, 2^32) from the first 8 hex digits of md5 over the keys joined by `|`."""
    cols = [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def between(lo: Column | int, hi: Column | int, *keys: Column | str | int) -> Column:
    """A number in [lo, hi] from the keys."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (lo, hi))
    return lo + u(*keys) % (hi - lo + 1)
