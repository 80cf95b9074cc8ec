"""Consistent-hash ring with virtual nodes and bounded loads.

A row's ring position is a hash of its id. Each shard owns many arcs of the
ring. A shard admits the rows of its own arcs, in ring order, up to its
capacity; what overflows continues clockwise to the next arc whose shard has
room. Capacities add up to the number of rows and differ by one at most, so
the law ``rows`` holds by construction, and only the overflow leaves its home.

The driver sees one count per cell of the ring (2**16, a bound that depends on
the ring, not on the data) and turns them into rank intervals of each arc; rows
are ranked within their cell and find their interval by an equi-join on the arc.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

CELL_BITS = 16
SHARDS, VNODES = 24, 64


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node in ring order; a taken cell passes to the next free one."""
    if shards < 1 or vnodes < 1 or shards * vnodes > 1 << (CELL_BITS - 1):
        raise ValueError(f"a ring of 2**{CELL_BITS} cells can't hold {shards} x {vnodes} virtual nodes")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = zlib.crc32(f"shard {shard} node {v}".encode()) * 2654435761 >> 8 & ((1 << CELL_BITS) - 1)
            while cell in taken:
                cell = (cell + 1) % (1 << CELL_BITS)
            taken[cell] = shard
    return sorted(taken.items())


def arc_of_cell(nodes: list[tuple[int, int]]) -> list[int]:
    """For each cell, the index of the first virtual node at it or clockwise after it."""
    cells = [c for c, _ in nodes]
    return [bisect_left(cells, c) % len(cells) for c in range(1 << CELL_BITS)]


def plan_segments(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where each run of an arc's rows goes."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    segments, left = [], []

    def put(arc: int, at: int, n: int, shard: int) -> int:
        take = min(n, room[shard] - used[shard])
        if take:
            segments.append((arc, at, at + take, shard, used[shard]))
            used[shard] += take
        return take

    for arc, (_, shard) in enumerate(nodes):
        n = counts.get(arc, 0)
        took = put(arc, 0, n, shard)
        if took < n:
            left.append((arc, took, n - took))
    for arc, at, n in left:
        step = arc
        while n:
            step = (step + 1) % len(nodes)
            took = put(arc, at, n, nodes[step][1])
            at, n = at + took, n - took
    return segments


def bounded_ring(rows: DataFrame, key: str, order: list[str], shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """``rows`` with home_shard, shard and slot (gapless from 0 in each shard).

    ``key`` places a row on the ring; a null key is placed by ``order`` instead.
    Rows that agree in key and ``order`` are interchangeable and get adjacent
    slots. An empty table gives no rows; columns named like the results are replaced.
    """
    spark = rows.sparkSession
    nodes = ring(shards, vnodes)
    arcs, homes = arc_of_cell(nodes), [s for _, s in nodes]
    rows = rows.drop("home_shard", "shard", "slot")
    at = F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))), F.xxhash64(*order))
    # The row travels as one struct, so that no name of its columns can clash with those below.
    placed = rows.select(F.struct(*rows.columns).alias("row"), F.col(key).alias("key"), F.struct(*order).alias("order"), at.alias("hash"))
    placed = placed.withColumn("cell", F.shiftrightunsigned("hash", 64 - CELL_BITS).cast("int"))
    # 2**16 counts at most whatever the data; so are the cells that are broadcast.
    cells, counts = [], {}
    for cell, n in sorted(tuple(r) for r in placed.groupBy("cell").agg(F.count("*")).collect()):
        cells.append((cell, arcs[cell], counts.get(arcs[cell], 0)))
        counts[arcs[cell]] = counts.get(arcs[cell], 0) + n
    segments = plan_segments(counts, nodes, shards)
    table = spark.createDataFrame(
        [(a, lo, hi, homes[a], s, slot) for a, lo, hi, s, slot in segments],
        "arc int, lo long, hi long, home_shard int, shard int, first_slot long",
    )
    # Ranks are counted cell by cell, so that a task sorts a cell and not an arc.
    within = Window.partitionBy("cell").orderBy("hash", "key", "order")
    ranked = (
        placed.withColumn("rank", (F.row_number().over(within) - 1).cast("long"))
        .join(F.broadcast(spark.createDataFrame(cells, "cell int, arc int, before long")), "cell")
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    # One segment per arc, and one more for each time that a shard fills up: bounded by the ring.
    return (
        ranked.join(F.broadcast(table), "arc")
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select("row.*", "home_shard", "shard", (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot"))
    )


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards, counts at most one apart (law ``rows``)."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return bounded_ring(docs, "doc_id", ["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
