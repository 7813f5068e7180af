import pytest


@pytest.fixture(scope="session")
def folder(spark):
    """A fresh work folder per call."""
    from storelens.llm.common import work_folder

    return lambda: work_folder(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, a column with a clashing name."""
    long = "lorem ipsum dolor sit amet " * 4000 + "x" * 20000
    rows = [(0, "the same words again and again in this little text", "en", "s", 1, 1.5), (1, None, None, None, None, None), (2, "", "de", "s", 0, None), (3, long, "en", None, 9, 0.1),
            (4, "the same words again and again in this little text", "en", "s", 1, 1.5), (4, "the same words again and again in this little text", "en", "s", 1, 1.5), (None, "a row without id", "en", "s", 1, 0.0), (5, "12 34 !?", "en", "s", 1, 0.0),
            (6, "naïve café über 😀 ́x \x1c\x85", "fr", "s", 1, 0.0), (7, " \t\n ", "fr", "s", 3, 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
