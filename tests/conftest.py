import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    return DATA


def rows(df):
    """Rows in a comparable form: columns by name, numbers rounded, order dropped."""
    import math

    import pandas as pd

    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool):
            return int(v)
        if isinstance(v, (int, float)) or hasattr(v, "is_integer"):
            return round(float(v), 4)
        return str(v)

    columns = sorted(df.columns)
    return columns, sorted(([plain(v) for v in r] for r in df[columns].astype(object).itertuples(index=False)), key=repr)


def oracle(sql, data):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{data}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c.sql(sql).df()
