import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from civilspark.session import local_session  # noqa: E402

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def small():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture
def column(spark):
    """Apply a column function to a list of values."""

    def apply(function, values, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(
            [(i, v) for i, v in enumerate(values)], f"i int, v {kind}"
        )
        rows = df.select("i", function(F.col("v")).alias("out")).collect()
        return [row.out for row in sorted(rows, key=lambda r: r.i)]

    return apply
