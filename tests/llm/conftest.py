import os

import pytest

os.environ["PYTHONPATH"] = os.pathsep.join(
    [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")]
)


@pytest.fixture
def table(spark):
    """A table of ``doc_id`` and ``text`` with extra columns that clash with inner names."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("*", "'x' AS id", "'y' AS sid", "1 AS n", "'z' AS score", "'k' AS key", "2 AS place").repartition(3)

    return make
