import pytest

ODD_TEXTS = [None, "", " \n\t ", "one", "a b c d e", "Ünïcödé tëxt with äöü", "x" * 5000, "word " * 3000]


@pytest.fixture
def documents(spark):
    """Documents with null ids and texts, empty and long texts, repeated rows, and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(20, base), (21, base), (21, base), (22, base.replace("w60", "other")), (None, base), (None, None), (23, base + " and more")]
    schema = "doc_id long, text string, score double, kept boolean, host string, ids string, removed_words string"
    return spark.createDataFrame([(i, t, 9.0, True, "h", "x", "y") for i, t in rows], schema)


@pytest.fixture
def no_documents(documents):
    return documents.limit(0)
