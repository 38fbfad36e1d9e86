import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, lang]) as a documents table, with a further column that clashes with results."""

    def make(rows, extra="kept"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), "own") for r in rows]
        return spark.createDataFrame(full, f"{DOCS}, {extra} string")

    return make
