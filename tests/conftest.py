import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


from pyspark.sql import SparkSession  # noqa: E402

# started before the test modules are imported, as these hold column expressions
SPARK = (
    SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
    .config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SPARK
    SPARK.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA
