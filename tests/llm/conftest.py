import pytest
from llm_texts import prose

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """A function from texts to a documents table: doc_id is the position."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


@pytest.fixture()
def odd_texts():
    """Nulls, empty, blank, tiny, repeated and very long texts."""
    long = prose(9, 30_000)
    return [None, "", "   \n\t ", "a", "a", "Word", prose(1, 80), prose(1, 80), long, long + " tail", "été naïve 中文 \U0001f600\x1c.x", "x" * 50_000, "\n\n\n", prose(2, 200)]
