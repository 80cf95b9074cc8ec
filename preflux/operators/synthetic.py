"""Seeded synthetic catalogues and ratings: the same rows under any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V


def vectors_for(rows: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """(row_index, e): a unit vector of normal numbers for each row_index."""
    cells = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: V.hash_normal(F.lit(seed), F.col("row_index"), i))
    return rows.select("row_index", V.unit(cells).alias("e"))


def catalogue(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """``vectors_for`` the rows from 0 to n - 1."""
    return vectors_for(spark.range(n).withColumnRenamed("id", "row_index"), dim, seed)


def ratings(items: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """(row_index, rating): m items without replacement, by the order of a hash, with normal ratings."""
    chosen = items.select("row_index").orderBy(V.hash_unit(F.lit(seed), F.col("row_index")), "row_index").limit(m)
    return chosen.withColumn("rating", V.hash_normal(F.lit(f"{seed}r"), F.col("row_index")))
