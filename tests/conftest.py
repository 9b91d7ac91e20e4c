import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """A text table with a ``row`` column from a dict of columns."""
    def build(columns, partitions=None):
        names = list(columns)
        rows = [(i, *vals) for i, vals in enumerate(zip(*columns.values()))]
        schema = ", ".join(["row bigint", *[f"`{n}` string" for n in names]])
        df = spark.createDataFrame(rows, schema)
        return df.repartition(partitions) if partitions else df
    return build
