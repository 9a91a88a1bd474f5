import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, with columns whose names clash with those the operators use inside."""

    def make(rows):
        schema = "doc_id long, text string, key string, row string, fp string, doc string, words string, place string, score string, count string"
        return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], schema)

    return make
