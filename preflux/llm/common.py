"""Helpers that the training-data operators share: scans, durable tables, text as words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Python's bytes.split() cuts at exactly these, so both sides agree on words.
SPACE = r"[\x20\x09-\x0D]+"

_own_root: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="preflux-")
    return _own_root[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    Files in a shared store outlive any executor, unlike cached or locally
    checkpointed blocks.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing will read again."""
    spark = df.sparkSession
    root = scratch_root(spark)
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.removeprefix("file://") in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """Words of a text (null: none), cut at ASCII white space."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE), lambda w: w != "")


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Of batches sorted by their first column: the columns of each key's rows, whole."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if parts and parts[0].column(0)[0].as_py() != key[a]:
                yield _columns(parts)
                parts = []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield _columns(parts)


def _columns(parts: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [c.to_numpy() for c in pa.Table.from_batches(parts).columns]


def lookup(rows: DataFrame, table: DataFrame, on: list[str], crowded: Column) -> DataFrame:
    """``rows`` left joined with ``table``, which has one row per key, however many rows share a key.

    The rows of ``table`` that ``crowded`` marks are broadcast, the others meet
    their rows in a shuffle. The caller's condition bounds their number: no more
    than a thousand keys can each have over a thousandth of the rows.
    """
    few = F.broadcast(table.where(crowded))
    rest = rows.join(few.select(*on), on, "left_anti").join(table.where(~crowded), on, "left")
    return rows.join(few, on).unionByName(rest)
