import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, memory="4g")


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression on one text."""
    from pyspark.sql import functions as F

    def value(text, build):
        df = spark.createDataFrame([(text,)], "text string")
        return df.select(build(F.col("text")).alias("x")).first()["x"]

    return value
