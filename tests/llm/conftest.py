import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, tie int, runs int"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1, 2) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
