from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


# Started before the test modules are read: they hold columns, which need a session.
from reviewlab.session import build_session  # noqa: E402

SPARK = build_session("tests", cores=4, shuffle_partitions=4, driver_memory="4g")
SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SPARK
    SPARK.stop()


@pytest.fixture
def value(spark):
    """Evaluate a column over one row of named values."""
    from pyspark.sql import functions as F

    def run(col, **columns):
        cols = [x if hasattr(x, "alias") else F.lit(x) for x in columns.values()]
        df = spark.range(1).select(*[c.alias(n) for n, c in zip(columns, cols, strict=True)])
        got = df.select(col.alias("v")).first()["v"]
        return got.asDict(recursive=True) if hasattr(got, "asDict") else got

    return run
