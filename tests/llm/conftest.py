import pytest


@pytest.fixture(scope="session")
def table(spark):
    """A small table with columns that clash with the operators' own names."""
    def make(rows, schema):
        clash = {"key": "x", "n": 1, "digest": "y", "node": 2, "unit": b"z", "spans": "s", "part": 3, "component": 4, "rule": "r"}
        from pyspark.sql import functions as F
        return spark.createDataFrame(rows, schema).select("*", *[F.lit(v).alias(k) for k, v in clash.items()])
    return make
