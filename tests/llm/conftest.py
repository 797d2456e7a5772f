import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows to a DataFrame with the columns of ``documents`` and a clashing extra one."""

    def build(rows, extra=True):
        full = [(i, t, lang, src, None if t is None else len(t), "x") for i, t, lang, src in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, label string")
        return df if extra else df.drop("label")

    return build


@pytest.fixture(scope="session")
def docs_of(make):
    return lambda texts: make([(i, t, "en", "s") for i, t in texts])
