import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluates a column function on single values."""
    from pyspark.sql import functions as F

    def run(rule, *values, kind="string"):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
        return [r.y for r in df.select("k", rule(F.col("x")).alias("y")).orderBy("k").collect()]

    return run
