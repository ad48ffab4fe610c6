import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("corpusloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="corpusloom-test-")


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row of named literals."""
    from pyspark.sql import functions as F

    def value(make, **inputs):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
        return row.select(make(*[F.col(k) for k in inputs]).alias("r")).first()["r"]

    return value
