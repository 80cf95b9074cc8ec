"""Rows with null or repeated ids are judged like the rest by near-dedup and decontamination."""

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, stage, rows, sf):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.text) for r in dict(cp.STAGES)[stage](spark, docs, sf).collect()), key=str)


def test_near_dedup(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(3, a), (3, a), (None, a), (None, b), (None, b + " more"), (5, c), (5, b.replace("b1 ", "b1 x ")), (9, c)]
    assert run(spark, "SimHash near-dedup", rows, sf) == sorted([(3, a), (5, b.replace("b1 ", "b1 x ")), (5, c)], key=str)
    assert run(spark, "SimHash near-dedup", [(None, a), (None, a)], sf) == [(None, a)]


def test_decontamination(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None, f"so {item} it goes"), (None, "nothing here"), (7, item), (7, "also nothing"), (8, "none")]
    assert run(spark, "benchmark decontamination", rows, sf) == sorted([(None, "nothing here"), (7, "also nothing"), (8, "none")], key=str)
