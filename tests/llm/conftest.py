import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
