import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows, lang="en", source="s"):
        schema = "doc_id long, text string, lang string, source string, n_chars long, node long, rep long, score double, host string"
        return spark.createDataFrame([(i, t, lang, source, None, 7, 8, 0.5, "h") for i, t in rows], schema)

    return make
