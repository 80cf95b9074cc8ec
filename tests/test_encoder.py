"""The trained encoder against a dense decomposition, and against hashing on the given documents."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from preflux.operators import encoder, interfaces

TEXTS = [None, "", "a b b c", "a c d", "b c d d", "e f g", "e f f h", "g h e", "A B\tc\nd", "zzz once", "f g h h e", "a b c d e"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_index long, text string")


def dense(texts):
    docs = [(t or "").lower().split() for t in texts]
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    terms = sorted((w for w in df if df[w] >= 2), key=lambda w: (-df[w], w))
    a = np.array([[d.count(w) * (np.log((1 + len(docs)) / (1 + df[w])) + 1) for w in terms] for d in docs])
    size = np.linalg.norm(a, axis=1, keepdims=True)
    return terms, np.divide(a, size, out=np.zeros_like(a), where=size > 0)


def test_basis_is_that_of_a_dense_decomposition(spark):
    rows = frame(spark, TEXTS).repartition(3)
    model = encoder.fit(rows, dims=3, grams=0)
    terms, a = dense(TEXTS)
    assert list(model.terms) == terms
    _, s, vt = np.linalg.svd(a)
    assert np.allclose(np.abs(np.sum(model.basis * vt[:3].T, axis=0)), 1, atol=1e-6)
    got = {r.row_index: np.array(r.e) for r in model.encode(frame(spark, TEXTS)).collect()}
    want = a @ model.basis
    for i, e in got.items():
        size = np.linalg.norm(want[i])
        assert np.allclose(e, want[i] / size if size > 1e-12 else 0 * want[i], atol=1e-9)
    weights = {(r.row_index, r.term): r.weight for r in model.weights(frame(spark, TEXTS)).collect()}
    assert len(weights) == (a > 0).sum() and all(abs(w - a[i, terms.index(t)]) < 1e-12 for (i, t), w in weights.items())


def test_small_and_empty_corpora(spark):
    assert encoder.fit(frame(spark, TEXTS).limit(0)).encode(frame(spark, ["a"])).first().e == [0.0] * encoder.DIMS
    two = encoder.fit(frame(spark, ["x y", "x y", "y"]), dims=50, grams=0)
    assert two.basis.shape == (2, 2) and abs(np.linalg.norm(two.encode(frame(spark, ["x"])).first().e) - 1) < 1e-9


def agreement(vectors, marks):
    """Share of rows whose nearest other row bears the same mark."""
    e = np.array(vectors)
    s = e @ e.T
    np.fill_diagonal(s, -2)
    return np.mean([marks[i] == marks[j] for i, j in enumerate(s.argmax(1))])


def test_beats_hashing_on_given_documents(spark):
    """By language. Which source a document has, its text doesn't tell: both agree on it by chance (0.05)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 200").selectExpr("doc_id AS row_index", "text", "lang")
    marks = [r.lang for r in docs.orderBy("row_index").collect()]
    trained = encoder.fit(docs).encode(docs).orderBy("row_index").toPandas()["e"].tolist()
    hashed = interfaces.HashingEncoder().encode(docs, "text").orderBy("row_index").toPandas()["e"].tolist()
    assert agreement(trained, marks) > max(0.999, agreement(hashed, marks))


def test_texts_are_read_twice_for_a_fit(spark):
    """Once for the terms and once for their counts, whatever the rounds; fewer texts than columns are no fault."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def marked(text):
        seen.add(1)
        return text

    encoder.fit(frame(spark, TEXTS).select("row_index", marked.asNondeterministic()("text").alias("text")), dims=3, powers=3)
    assert seen.value == 2 * len(TEXTS)


def test_places_are_those_of_the_features(monkeypatch):
    monkeypatch.setattr(encoder, "WORDS", 2)
    for grams in (0, 3):
        places = encoder._Places(grams)
        for text in [*TEXTS, "abc abcd abc d"]:
            at, n = places.counts(text)
            names = list(places.place)
            assert {names[i]: c for i, c in zip(at, n, strict=True)} == Counter(encoder.features(text, grams))


def test_corpus_encoded_from_its_counts(spark):
    rows = frame(spark, TEXTS)
    model, out = encoder.fit_encode(rows, dims=3)
    a, b = (sorted(df.collect()) for df in (out, model.encode(rows)))
    assert [r.row_index for r in a] == list(range(len(TEXTS))) and np.allclose([r.e for r in a], [r.e for r in b])
    assert encoder.fit_encode(rows.limit(2))[1].count() == 2
