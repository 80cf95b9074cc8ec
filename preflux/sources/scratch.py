"""Working tables in the shared folder of ``spark.checkpoint.dir``: lineage ends there, and no executor's loss undoes them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder; on a local master without one, a folder of this application's own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="preflux-"))


def fresh(spark: SparkSession, label: str) -> str:
    return f"{root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` as a table of its own, in folders by the values of the columns ``by``."""
    path = fresh(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _union(tables: list[DataFrame]) -> DataFrame:
    """By halves, for a plan that is not deep."""
    half = len(tables) // 2
    return tables[0] if len(tables) == 1 else _union(tables[:half]).unionByName(_union(tables[half:]))


def gathered(parts: list[list[DataFrame]]) -> DataFrame:
    """A partition for each of ``parts``, with the rows of its tables one after the other. Nothing is shuffled: a task reads what it needs from the shared folder."""
    first = parts[0][0]
    # A union of single partitions alone would be zipped into one; an empty table of two keeps them apart.
    apart = first.sparkSession.range(0, 2, 1, 2).where(F.spark_partition_id() < 0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in first.schema])
    return _union([*(_union(tables).coalesce(1) for tables in parts), apart])


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``written``."""
    top = root(df.sparkSession).removeprefix("file://") + "/"
    for table in {f[: f.index(top)] + top + f[f.index(top) + len(top) :].partition("/")[0] for f in df.inputFiles() if top in f}:
        files.remove(table)
