import pytest


@pytest.fixture
def frame(spark):
    """Rows with columns that clash with names used inside the operators."""
    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "1L as id", "'x' as h", "2 as fp", "'y' as _id", "3L as c", "'z' as host",
                             "array(1) as ids", "4L as n")
    return make
