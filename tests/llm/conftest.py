import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (id, text) or (id, text, lang, source) rows, with extra columns that clash with names used inside."""

    def table(rows, **more):
        full = [(*r, *("en", "s0")[len(r) - 2 :], len(r[1]) if r[1] is not None else None, 7, "x", -1) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, hash string, n bigint").repartition(3)

    return table
