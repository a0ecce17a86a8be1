import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark
    s = get_spark("local[4]", app="tessera-tests", shuffle_partitions=8,
                  **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tessera-test-ckpt-"),
                     "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def tiny_nulls(spark):
    rows = [(1, 1.0, "a"), (2, 2.5, "b"), (3, 2.5, "a"), (4, 7.0, None), (5, None, "b"), (6, 11.0, "b")]
    return spark.createDataFrame(rows, "id int, x double, c string")


@pytest.fixture(scope="session")
def rolling_nulls(spark):
    vals = [None, 1.0, 2.0, None, 4.0, 5.0, 6.0]
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, x double")
