"""Connected components by alternating large-star and small-star steps (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    return (
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col("hi").isNotNull() & F.col("lo").isNotNull() & (F.col("hi") != F.col("lo")))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """One row (node, component) per node of ``edges``; component is the smallest node reachable.

    Every step is an aggregate by node and an equi-join, so a hub with very
    many neighbours is pre-aggregated by ``min`` and its join side can be split
    at run time. Null ends and loops are ignored; no edges give no rows. Each
    round is written to the shared folder, so a lost executor costs one round.
    """
    now = materialize(_ordered(edges, a, b), "edges")
    state = _state(now)
    for _ in range(rounds):
        if state[0] == 0:
            break
        least = now.groupBy("hi").agg(F.min("lo").alias("m"))
        large = (
            now.join(least.select(F.col("hi").alias("lo"), "m"), "lo", "left")
            .select("hi", F.coalesce("m", "lo").alias("lo"))
            .distinct()
        )
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            low.select("hi", F.col("m").alias("lo"))
            .unionByName(large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            .distinct()
        )
        then = materialize(small, "edges")
        discard(now)
        now, before = then, state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
