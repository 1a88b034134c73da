"""Memory of the driver and files that lie on disk."""

import os
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from strandflow.llm import phrases, toxicity


def test_a_fit_holds_little_beside_its_features():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(4096, 1000, replace=False)).astype(np.uint16) for _ in range(2000)]
    y = np.array([float(r[0] % 2) for r in rows])
    tracemalloc.start()
    w, bias, _ = toxicity.fit_logistic(rows, y, np.ones(4096), rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20 and np.isfinite(w).all() and np.isfinite(bias)


def test_sketches_leave_no_shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {os.path.join(at, f) for d in dirs for at, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = files()
    rows = spark.createDataFrame([("en", "a b c a b c")] * 20, "lang string, text string").repartition(3).select(F.col("lang"), F.col("text"))
    phrases.sketch(rows, 2, 10, 3)
    assert not files() - before
