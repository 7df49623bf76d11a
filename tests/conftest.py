import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from reelrank.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="reelrank-tests")
    yield s
    s.stop()


@pytest.fixture()
def f1(spark):
    """FIXTURES F1 ratings."""
    rows = [(1, 10, 4.0, 100), (1, 11, 2.0, 200), (1, 12, 5.0, 300), (2, 10, 5.0, 86500), (2, 12, 3.0, 400),
            (3, 10, 3.0, 500)]
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double, timestamp bigint").select(
        "user_id", "item_id", __import__("pyspark.sql.functions", fromlist=["col"]).col("rating")
        .cast("decimal(2,1)").alias("rating"), "timestamp")
