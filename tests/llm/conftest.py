import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of documents from (doc_id, text) pairs, with an extra column that clashes."""

    def make(rows, columns="doc_id long, text string"):
        full = [(*r, f"x{i}") for i, r in enumerate(rows)]
        return spark.createDataFrame(full, columns + ", shard string")

    return make
