"""Each stage against a plain version of it, whole runs, and odd inputs."""

import corpus_pipeline as cp
from preflux.llm import bpe, pii, quality

from .test_near_copies import brute_stay
from .test_texts import brute_statistics


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, docs, sf):
    stages = dict(cp.STAGES)
    kept = stages["quality rules"](spark, docs, sf)
    rules = quality.fit_rules(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    judged = {r.doc_id: r.rule for r in quality.with_statistics(docs).withColumn("rule", quality.verdict(rules)).collect()}
    want = []
    for r in docs.collect():
        s = brute_statistics(r.text)
        if s[0] >= 10 and 100 * s[4] <= 20 * s[0] and judged[r.doc_id] is None:
            want.append((r.doc_id, r.text))
    assert texts(kept) == sorted(want, key=str) and kept.columns == docs.columns

    unique = stages["SimHash near-dedup"](spark, kept, sf)
    stay = brute_stay(sorted(want))
    want = [(i, t) for i, t in want if i in stay]
    assert texts(unique) == sorted(want, key=str) and unique.columns == docs.columns

    clean = stages["benchmark decontamination"](spark, unique, sf)

    def shingles(t):
        import re

        w = [x for x in re.split(r"[\W_]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [(i, t) for i, t in want if not any(len(x & shingles(t)) >= 0.8 * len(x) for x in items)]
    assert texts(clean) == sorted(want, key=str)

    masked = stages["PII"](spark, clean, sf)
    field = pii.trained_field()
    found = pii.find_spans(field, [t for _, t in want])
    want = [(i, pii.masked(t, s)) for (i, t), (_, s) in zip(want, found, strict=True)]
    assert texts(masked) == sorted(want, key=str) and all(r.n_chars == len(r.text) for r in masked.collect())
    assert not any(pii.base_spans(t) for _, t in want) and masked.columns == docs.columns

    out = {r.doc_id: (r.ids, r.decoded) for r in stages["BPE encoding and decoding"](spark, masked, sf).collect()}
    coder = bpe.PairIndexBPE(bpe.vocabulary_path())
    ids, decoded = coder.encode_batch([t for _, t in want])
    assert out == {i: (list(memoryview(x).cast("I")), d) for (i, _), x, d in zip(want, ids, decoded, strict=True)}
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == set(out)


def test_odd(spark, odd, sf):
    """No stage fails, loses a column or changes an extra one; an empty table stays empty."""
    odd = odd.selectExpr("*", "1 AS rule", "'k' AS kept", "2 AS component_id", "3 AS item_id", "'m' AS masked_text", "'q' AS quality_stats", "4 AS base_failed", "5 AS spans")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns
        assert {(r.rule, r.kept, r.component_id, r.item_id, r.masked_text, r.quality_stats, r.base_failed, r.spans) for r in out.collect()} <= {(1, "k", 2, 3, "m", "q", 4, 5)}
        assert stage(spark, odd.limit(0), sf).count() == 0
    assert cp.STAGES[-1][1](spark, odd, sf).count() == odd.count()
