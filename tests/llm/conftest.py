import pytest


@pytest.fixture
def docs(spark):
    """(doc_id, text) rows as a table with columns whose names clash with inner ones."""
    def make(rows):
        schema = "doc_id long, text string, lang string, sig long, row_key string, _bytes int, bucket int, size string"
        return spark.createDataFrame([(i, t, "en", 1, "k", 2, 3, "s") for i, t in rows], schema)
    return make
