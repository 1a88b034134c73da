"""A numbered table as a data set for training loops: length, rows by number, shards for workers, streams to the driver."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def number_rows(df: DataFrame, path: str, *order: Column | str) -> Records:
    """Writes df under path with `row`, the place of each row in the given order from 0, and opens it.

    Rows are range-sorted; each partition's first number follows from the counts of those before it, one number a partition on the driver. Give
    an order without ties where numbers must not change when the table is written again."""
    sorted_path, place = f"{path}/sorted", F.monotonically_increasing_id()
    df.orderBy(*order).withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND((1 << 33) - 1)}).write.mode("overwrite").parquet(sorted_path)
    spark = df.sparkSession
    ranged = spark.read.parquet(sorted_path)
    before, total = {}, 0
    for part, n in sorted(map(tuple, ranged.groupBy("_part").count().collect())):
        before[part] = total
        total += n
    starts = spark.createDataFrame(list(before.items()) or [(-1, 0)], "_part long, _before long")
    ranged.join(F.broadcast(starts), "_part").select((F.col("_before") + F.col("_at")).alias("row"), *df.columns).write.mode("overwrite").parquet(f"{path}/rows")
    return Records(spark, path)


class Records:
    """Rows by number. `row` is sorted within files, so a lookup reads the row groups that may hold it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = spark.read.parquet(f"{path}/rows")
        self._n: int | None = None

    def __len__(self) -> int:
        if self._n is None:
            self._n = self.table.count()
        return self._n

    def __getitem__(self, at: int | slice) -> Row | list[Row]:
        if isinstance(at, slice):
            start, stop, step = at.indices(len(self))
            if step != 1:
                raise ValueError("a step of one only")
            return self.table.where((F.col("row") >= start) & (F.col("row") < stop)).orderBy("row").collect()
        if not -len(self) <= at < len(self):
            raise IndexError(at)
        return self.table.where(F.col("row") == at % len(self)).first()

    def shard(self, rank: int, shards: int) -> DataFrame:
        """Rows rank, rank + shards, ...: what one of several workers reads."""
        return self.table.where(F.pmod("row", F.lit(shards)) == rank)

    def __iter__(self) -> Iterator[Row]:
        """All rows in order, a partition at a time on the driver."""
        return self.table.orderBy("row").toLocalIterator(prefetchPartitions=True)


def apply_rows(df: DataFrame, function, schema: str) -> DataFrame:
    """function over pandas frames of rows, batch by batch, for transformations that no column expression states."""
    return df.mapInPandas(lambda frames: map(function, frames), schema)


def apply_groups(df: DataFrame, keys: tuple[str, ...], function, schema: str) -> DataFrame:
    """function over the pandas frame of each group; a group must fit a task's memory."""
    return df.groupBy(*keys).applyInPandas(function, schema)
