import pytest
from cases import ODD


@pytest.fixture()
def frame(spark):
    """Rows to a DataFrame of the documents table's columns."""

    def make(rows, extra=""):
        return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long{extra}")

    return make


@pytest.fixture()
def odd(frame):
    return frame(ODD)


@pytest.fixture()
def odd_extra(frame):
    """Columns whose names clash with results."""
    return frame([(*r, 7, "x", True, 1.5) for r in ODD], ", n_tokens int, keep_id string, kept boolean, score double")


@pytest.fixture()
def none(frame):
    return frame([])
