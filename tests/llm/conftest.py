import pytest
from pyspark.sql import types as T


@pytest.fixture
def frame(spark):
    """frame(schema, rows): a DataFrame of a few rows."""

    def make(schema, rows):
        return spark.createDataFrame(rows, T.StructType.fromDDL(schema))

    return make
