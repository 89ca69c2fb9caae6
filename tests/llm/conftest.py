import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string, cls int, id string, grp string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table of texts (or of (id, text, lang, source)), with extra columns whose names operators might use."""

    def make(rows):
        full = []
        for k, r in enumerate(rows):
            i, text, lang, source = r if isinstance(r, tuple) else (k, r, "en", "s")
            full.append((i, text, lang, source, len(text) if text is not None else None, "x", 1, "y", "z"))
        return spark.createDataFrame(full, DOCS)

    return make
