import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("fieldsift-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Apply a text expression to a list of strings, in order."""
    from pyspark.sql import functions as F

    def apply(values, build):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
        got = rows.select("i", build(F.col("x")).alias("y")).collect()
        return [r.y for r in sorted(got, key=lambda r: r.i)]

    return apply
