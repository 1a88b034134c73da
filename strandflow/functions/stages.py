"""Tables written to the folder that a cluster's driver and executors share (spark.checkpoint.dir), to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; where none is set, a local master (tests) uses a temporary one and a cluster raises."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="strandflow-"))
        base = _own[0]
    path = f"{base.rstrip('/')}/strandflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
