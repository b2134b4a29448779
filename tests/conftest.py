import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadframe.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark(master="local[4]", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def one_col(spark, values, expr_fn, schema="v string"):
    """Apply a column rule to a one-column frame; return the results in order."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    out = df.select("i", expr_fn(F.col("v")).alias("out")).orderBy("i")
    return [r["out"] for r in out.collect()]
