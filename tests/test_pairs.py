"""Tables of all pairs: dealt to tasks by the number of pairs, whole, and small in a file."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from preflux.operators import gp


def frame(spark, n, seed, width=16):
    x = np.random.default_rng(seed).normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "row_index long, e array<double>").coalesce(1)


def test_a_task_returns_its_share_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(gp, "TASK_PAIRS", 400, raising=False)
    monkeypatch.setattr(gp, "PAIR_CELLS", 150)
    (x, vectors), (y, queries) = frame(spark, 120, 1), frame(spark, 50, 2)
    for wave_bytes in (64 << 20, 2_000):
        monkeypatch.setattr(gp, "WAVE_BYTES", wave_bytes)
        rows = gp.pairs(vectors, queries, "d2", gp.squared_distances).withColumn("task", F.spark_partition_id()).toPandas()
        assert len(rows) == 120 * 50 and not rows.duplicated(["row_index", "rated_index"]).any()
        want = gp.squared_distances(x, y)[rows["row_index"] // 7, rows["rated_index"] // 7]
        assert np.abs(rows["d2"] - want).max() < 1e-12
        assert rows.groupby("task").size().max() <= 800


def test_no_queries_no_pairs(spark):
    _, vectors = frame(spark, 5, 1)
    assert gp.pairs(vectors, vectors.where("false"), "d2", gp.squared_distances).count() == 0
    assert gp.pairs(vectors.where("false"), vectors, "d2", gp.squared_distances).count() == 0


def test_a_pair_takes_few_bytes(spark, tmp_path):
    """Two numbers and a double, rounded as the queries return it, took over eight bytes."""
    _, v = frame(spark, 1_000, 3, 64)
    gp.pairs(v, v, "k", lambda a, b: gp.kernel(a, b, 1.0, 1.0)).withColumn("k", F.round("k", 6)).write.parquet(str(tmp_path / "k"))
    files = list((tmp_path / "k").glob("*.parquet"))
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 1_000_000
    assert sum(f.stat().st_size for f in files) < 7 * 1_000_000
