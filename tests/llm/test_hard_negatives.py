"""Hard negatives against a plain sort of all scores."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from preflux.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, id long, window long, score string"


def brute(rows, every, relabel=False):
    table = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if relabel and i % 7 == 0 else label
        table[i] = min(table.get(i, (label, v)), (label, v))
    ints = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in table.items()}
    out = Counter()
    for a, (label, q) in ints.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, other) for i, (other, v) in ints.items())
        for p, pid, _ in [s for s in scored if s[2] == label and s[1] != a][:5]:
            window = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            for rank, (n, nid, _) in enumerate(window, 1):
                out[a, pid, rank, nid, -p, -n] += 1
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def mined(df, every):
    return rows_of(H.hard_negatives(H.materialize(H.usable_rows(df), "t"), F.col("id") % every == 0))


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = rows_of(H.op13_radix_negatives(spark, sf))
    assert got == brute(rows, 50, relabel=True) and sum(got.values()) > 100


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, non-finite components, repeated ids and rows, short and zero vectors, many copies and ties, negative and huge ids, a lone label."""
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist(), int(i % 3)) for i in range(-60, 400)]
    rows += [(1000 + i, [0.5] * 8, i % 2) for i in range(700)] + [(1 << 62, [0.5] * 8, 0), (-(1 << 62), [0.5] * 8, 1), (5000, [0.3] * 8, 1), (5010, [0.3, 0.1], 0), (5020, [], 1), (5030, [0.0] * 8, 0)]
    rows += [(None, [1.0] * 8, 1), (6000, None, 1), (6010, [1.0, None], 1), (6020, [math.nan] * 8, 1), (6030, [math.inf] * 8, 1), (6040, [1.0] * 8, None), (20, [9.0] * 8, 0), (20, [9.0] * 8, 0), (6050, [1.0] * 8, 77)]
    return rows


def test_odd_rows(spark, odd_rows):
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in odd_rows], SCHEMA)
    assert mined(df, 10) == brute(odd_rows, 10)


def test_small_waves_and_buckets(spark, odd_rows, monkeypatch):
    """Several waves, and buckets refined to the last digit of the ids, give the same."""
    monkeypatch.setattr(H, "WAVE_BYTES", 1000)
    monkeypatch.setattr(H, "SPARE", 0)
    some = [x for x in odd_rows if x[0] is not None and x[0] % 20 == 0 or x[0] is None or x[0] >= 1000]
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in some], SCHEMA)
    assert mined(df, 200) == brute(some, 200)


def test_scores_beyond_double_precision(spark):
    big = [(i, [1e6 + i * 37 / 256, 3e6 - i / 256, 2.0], i % 2) for i in range(60)]
    assert mined(spark.createDataFrame([(*r, 1, 2, "s") for r in big], SCHEMA), 10) == brute(big, 10)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark.createDataFrame([(i, [1e9], i % 2, 1, 2, "s") for i in range(4)], SCHEMA), 2)


def test_empty_tables(spark, odd_rows):
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in odd_rows], SCHEMA)
    assert mined(df.limit(0), 10) == Counter() == mined(df.where("vec_id % 10 <> 0"), 10)
