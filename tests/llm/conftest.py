import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema="doc_id bigint, text string", extra=None):
        return spark.createDataFrame(rows, schema)

    return make
