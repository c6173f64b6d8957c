import pytest


@pytest.fixture(autouse=True)
def small_batches(spark):
    from gapengine.llm.queries import prepared

    prepared(spark)


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text), with columns whose names clash with those operators use."""

    def make(*rows):
        full = [(i, t, "en", "s", None, -1, "x", "y", "z") for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, id string, kept string, key string")

    return make
