import pytest

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, and extra columns whose names clash with working names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    texts = [None, "", " \n\t ", "one", "One two three four five six seven", "One two three four five six seven", long, long + " end", "é" * 300, "Σ mail a.b@c.de +1 (132) 555-1352 10.0.0.1 4417123456789113"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, "one"), (None, None)]
    extra = "id long, fp long, chunk long, key string, shingle long, n long, component string, w string"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, "k", 5, 6, "c", "w") for i, t in rows], f"{DOCUMENTS}, {extra}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
