import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines_of(spark):
    """Numbered lines of one or more files from lists of texts."""

    def make(files, mtime="2015-06-30 00:00:00"):
        if isinstance(files, list):
            files = {"a.log": files}
        rows = [
            (name, n, raw) for name, texts in files.items() for n, raw in enumerate(texts, 1)
        ]
        df = spark.createDataFrame(rows, "file string, line_no bigint, raw string")
        return df.selectExpr("file", f"timestamp '{mtime}' AS file_mtime", "line_no", "raw")

    return make
