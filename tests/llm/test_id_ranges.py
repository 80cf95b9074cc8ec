"""Chunks of the suffix operator by ranges of ids: in order, whatever the ids and however few the quantiles."""

import numpy as np
import pandas as pd
import pytest

from preflux.llm import chunks, suffix_dedup


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_chunks_rise_with_ids(parts):
    rng = np.random.default_rng(1)
    ids = np.sort(np.r_[rng.integers(-(1 << 62), 1 << 62, 500), rng.integers(0, 50, 500), -(1 << 63), (1 << 63) - 1])
    edges = np.quantile(ids.astype(float), np.linspace(0, 1, 6)).clip(-(1 << 62), 1 << 62).astype(np.int64)
    got = suffix_dedup.id_chunks(pd.Series(ids), edges, parts)
    assert (np.diff(got) >= 0).all() and got[0] >= 0 and got[-1] < 5 * parts
    assert suffix_dedup.id_chunks(pd.Series([None, 3.0]), edges, parts)[0] == 5 * parts
    assert len(set(suffix_dedup.id_chunks(pd.Series(range(100)), np.array([0, 50, 99]), parts))) == 2 * parts


def removed_by_hand(rows):
    """Bytes covered by a string that starts earlier too, document by document."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - suffix_dedup.LENGTH + 1):
            part = data[a : a + suffix_dedup.LENGTH]
            if part in seen:
                gone[a : a + suffix_dedup.LENGTH] = True
            seen.add(part)
        out[i] = int(gone.sum())
    return out


def test_ranges_with_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    passages = ["".join(rng.choice(list("abcdefgh "), 160)) for _ in range(5)]
    rows = [(int(rng.integers(-9, 9) * 10**9 + i), "".join(rng.choice(list("abcdefgh "), 90)) + passages[i % 5] + str(i)) for i in range(60)]
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "RANGES", 3)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_strings(table).collect()}
    assert got == removed_by_hand(rows) and sum(got.values()) > 0
