"""Nearest-neighbour graph by NN-descent, its fuzzy union, and a layout in the plane.

The graph starts from blocks of rows around common pivots, exact inside, of several sets of pivots, and
is improved by rounds in which neighbours of a row are tried as neighbours of each other;
every distance in it is computed from the vectors. Edge weights are those of a fuzzy
set around each row, united in both directions. The layout moves the rows of a block at a
time against neighbours and a bounded pool of strangers that stay where they were when
the round began. Edges are tables throughout; nothing but the pool is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V
from ..sources import scratch
from . import gp

#: Rows of a starting block on average and pivots at most; sets of pivots; the share of edges that may still change when descent ends; rounds at most.
BLOCK, PIVOTS, STARTS, SETTLED, ROUNDS = 2_048, 4_096, 3, 0.001, 12
#: The curve 1 / (1 + a d^2b) of the layout for a least distance of 0.1.
CURVE_A, CURVE_B = 1.577, 0.895
#: Rows moved together, strangers in the pool, strangers for each neighbour, rounds over all blocks, steps of a block in a round.
LAYOUT_BLOCK, POOL, STRANGERS, LAYOUT_ROUNDS, STEPS = 4_096, 1_024, 5, 8, 25

#: Pairs of rows of small groups that are multiplied at once.
PAIRS = 1 << 20
#: Bytes of rows that a pass over all rows takes along when the graph is exact.
WAVE_BYTES = 16 << 20

EDGES = "row_index long, neighbour long, distance double"


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    """Each row's k nearest among the others."""
    out = []
    for at in range(0, len(ids), 512):
        d = gp.squared_distances(x[at : at + 512], x)
        d[ids[at : at + 512][:, None] == ids[None, :]] = np.inf
        last = min(k, len(ids)) - 1
        rows, cols = np.nonzero((d <= np.partition(d, last, axis=1)[:, last : last + 1]) & np.isfinite(d))
        order = np.lexsort((ids[cols], d[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        fine = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        rows, cols = rows[fine], cols[fine]
        out.append((ids[at : at + 512][rows], ids[cols], np.sqrt(d[rows, cols])))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["row_index", "neighbour", "distance"])


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct neighbours of each row, ties to the smaller id."""
    one = edges.groupBy("row_index", "neighbour").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("row_index").orderBy("distance", "neighbour"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k)


def _started(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """Edges inside blocks: rows meet at the nearest of a bounded number of pivots, crowded blocks are cut by a hash."""
    n = vectors.count()
    pivots = gp.matrix(vectors.orderBy(F.xxhash64(F.lit(seed), "row_index"), "row_index").limit(max(1, min(PIVOTS, -(-n // BLOCK)))).select("e").toPandas()["e"])
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                block = gp.squared_distances(V.batch_matrix(batch.column(1)), shared.value).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block)], ["row_index", "e", "block"])

    dealt = vectors.select("row_index", "e").mapInArrow(place, "row_index long, e array<double>, block long")
    cuts = dealt.groupBy("block").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("cuts"))
    dealt = dealt.join(F.broadcast(cuts), "block").withColumn("cut", F.pmod(F.xxhash64(F.lit(seed), "row_index"), F.col("cuts")))
    return dealt.select("block", "cut", "row_index", "e").groupBy("block", "cut").applyInArrow(lambda t: pa.Table.from_batches([_nearest(t.column("row_index").to_numpy(), V.batch_matrix(t.column("e").combine_chunks()), k)]), EDGES)


def _nearest_in_groups(group: np.ndarray, ids: np.ndarray, x: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k nearest of its group's others that are no farther than ``far``; the rows come sorted by group, and groups are small."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    counts = np.diff(np.r_[starts, len(group)])
    found: tuple[list, list, list] = ([], [], [])
    for n in np.unique(counts):  # groups of one size are one stack of matrices
        of = starts[counts == n]
        step = max(1, PAIRS // (n * n))
        for at in (of[i : i + step, None] + np.arange(n) for i in range(0, len(of), step)):
            y, own = x[at], ids[at]
            norms = (y * y).sum(2)
            d = np.maximum(norms[:, :, None] + norms[:, None, :] - 2.0 * y @ y.transpose(0, 2, 1), 0.0)
            d[own[:, :, None] == own[:, None, :]] = np.inf
            top = np.lexsort((np.broadcast_to(own[:, None, :], d.shape), d), axis=2)[:, :, :k]
            near = np.sqrt(np.take_along_axis(d, top, 2))
            keep = np.isfinite(near) & (near <= far[at][:, :, None])
            found[0].append(np.broadcast_to(own[:, :, None], top.shape)[keep])
            found[1].append(np.take_along_axis(np.broadcast_to(own[:, None, :], d.shape), top, 2)[keep])
            found[2].append(near[keep])
    return tuple(np.concatenate(part) for part in found)


def _improved(graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Edges among the neighbours of each row, those that name it included: of either kind k at most, which bounds a group.

    An edge longer than all k that its row has can't enter, and is left out where it arises. A task takes its groups together.
    """
    named = graph.select(F.col("neighbour").alias("row_index"), F.col("row_index").alias("neighbour"))
    some = F.row_number().over(Window.partitionBy("row_index").orderBy(F.xxhash64("row_index", "neighbour")))
    # A row that very many name would be one window of all of them: their number is cut down within salts first.
    salted = named.withColumn("n", F.row_number().over(Window.partitionBy("row_index", F.pmod(F.xxhash64("neighbour"), F.lit(64))).orderBy(F.xxhash64("row_index", "neighbour")))).where(F.col("n") <= k).drop("n")
    members = graph.select("row_index", "neighbour").unionByName(salted.withColumn("n", some).where(F.col("n") <= k).drop("n")).distinct()
    # The products of a round differ in the last places from those before, so a hair is allowed.
    reach = graph.groupBy("row_index").agg(F.when(F.count("*") >= k, F.max("distance") * (1 + 1e-9) + 1e-9).otherwise(F.lit(float("inf"))).alias("far"))
    rows = vectors.select(F.col("row_index").alias("neighbour"), "e").join(reach.withColumnRenamed("row_index", "neighbour"), "neighbour", "left")
    held = members.join(rows, "neighbour").select("row_index", "neighbour", "e", F.coalesce("far", F.lit(float("inf"))).alias("far"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = pa.table(batch) if rest is None else pa.concat_tables([rest, pa.table(batch)])
            own = whole.column("row_index").to_numpy()
            # The last group may go on in the next batch.
            end = int(np.searchsorted(own, own[-1])) if len(own) else 0
            if end:
                yield of(whole.slice(0, end))
            rest = whole.slice(end)
        if rest is not None and len(rest):
            yield of(rest)

    def of(table: pa.Table) -> pa.RecordBatch:
        own, ids, far = (table.column(c).to_numpy() for c in ("row_index", "neighbour", "far"))
        found = _nearest_in_groups(own, ids, V.batch_matrix(table.column("e").combine_chunks()), far, k)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["row_index", "neighbour", "distance"])

    return held.repartition("row_index").sortWithinPartitions("row_index").mapInArrow(run, EDGES)


def knn_graph(vectors: DataFrame, k: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """(row_index, neighbour, distance, rank) of about the k nearest other rows of each of (row_index, e), by Euclidean distance.

    Distances are exact, which neighbours are found isn't certain: rounds go on until fewer than SETTLED of the edges change. Fewer than k + 1
    rows give as many edges as there are; ids are distinct.
    """
    rows = scratch.written(vectors.select("row_index", F.col("e").cast("array<double>").alias("e")), "rows")
    if rows.count() <= BLOCK:  # all pairs
        return scratch.written(_best(_started(rows, k, 0), k), "graph")
    # Blocks of one set of pivots alone have no edges between them, and descent would make none.
    graph = scratch.written(_best(reduce(DataFrame.unionByName, [_started(rows, k, seed) for seed in range(STARTS)]), k), "graph")
    for _ in range(rounds):
        then = scratch.written(_best(graph.drop("rank").unionByName(_improved(graph, rows, k)), k), "graph")
        new = then.join(graph, ["row_index", "neighbour"], "left_anti").count()
        scratch.drop(graph)
        graph = then
        if new <= SETTLED * graph.count():
            break
    return graph


def _nearest_among(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k nearest of ``others``, itself left out; equal vectors are equally far, and ties go to the smaller id."""
    norms, found = (y * y).sum(1), ([], [], [])
    for at in range(0, len(ids), 256):
        q, own = x[at : at + 256], ids[at : at + 256]
        d = (q * q).sum(1)[:, None] + norms[None, :] - 2.0 * q @ y.T
        d[own[:, None] == others[None, :]] = np.inf
        last = min(k, len(others)) - 1
        # Products of a matrix differ in the last places by where a row stands, so what is as near as that is computed once more, term by term.
        near = d <= np.partition(d, last, axis=1)[:, last : last + 1] + 1e-9 * (1.0 + norms.max(initial=0.0))
        i, j = np.nonzero(near & np.isfinite(d))
        exact = np.sqrt(((q[i] - y[j]) ** 2).sum(1))
        order = np.lexsort((others[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        for part, values in zip(found, (own[i], others[j], exact), strict=True):
            part.append(values[keep])
    return tuple(np.concatenate(part) for part in found)


def exact_graph(vectors: DataFrame, k: int = 10) -> DataFrame:
    """(row_index, neighbour, distance, rank) of the k nearest other rows of each of (row_index, e), whole.

    Every row meets every other, as the contract asks; the rows go along as WAVE_BYTES at a time, and a task holds its batch's k nearest alone.
    """
    rows = vectors.select("row_index", F.col("e").cast("array<double>").alias("e"))
    waves = max(1, -(-(rows.agg(F.sum(F.size("e"))).first()[0] or 0) * 8 // WAVE_BYTES))
    of = F.pmod(F.xxhash64("row_index"), F.lit(waves))
    context = rows.sparkSession.sparkContext

    def wave(w: int) -> DataFrame:
        table = rows.where(of == w).toPandas()
        shared = context.broadcast((table["row_index"].to_numpy(np.int64), gp.matrix(table["e"])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            others, y = shared.value
            for batch in batches:
                if len(batch) and len(others):
                    columns = _nearest_among(batch.column(0).to_numpy(), V.batch_matrix(batch.column(1)), others, y, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row_index", "neighbour", "distance"])

        return spread.mapInArrow(run, EDGES)

    spread = scratch.written(rows.repartition(4 * max(1, context.defaultParallelism)), "rows")
    return _best(reduce(DataFrame.unionByName, [wave(w) for w in range(waves)]), k)


def _memberships(d: np.ndarray, k: int) -> np.ndarray:
    """Weights of the edges of each row of ``d`` (rows x edges): bisection of all rows' scales at once."""
    first = np.where(d > 0, d, np.inf).min(1, keepdims=True)
    over = np.maximum(d - np.where(np.isfinite(first), first, 0.0), 0)
    low, high, scale = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    open_ = np.ones(len(d), bool)
    for _ in range(64):
        total = np.exp(-over / scale[:, None]).sum(1)
        open_ &= np.abs(total - np.log2(k)) >= 1e-5
        if not open_.any():
            break
        high, low = np.where(open_ & (total > np.log2(k)), scale, high), np.where(open_ & (total <= np.log2(k)), scale, low)
        scale = np.where(open_, np.where(np.isfinite(high), (low + high) / 2, scale * 2), scale)
    scale = np.maximum(scale, np.maximum(1e-3 * d.mean(1), 1e-12))
    return np.exp(-over / scale[:, None])


def fuzzy_union(graph: DataFrame, k: int) -> DataFrame:
    """(row_index, neighbour, weight) in both directions: membership falls off from the nearest neighbour on so that the weights of a row come to log2(k); a + b - ab unites both."""

    row = F.struct("neighbour", "distance")
    lists = graph.groupBy("row_index").agg(F.sort_array(F.collect_list(row)).alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column(1)
            n, cells = np.diff(z.offsets.to_numpy()), z.flatten()
            d = cells.field(1).to_numpy()
            for size in np.unique(n):  # rows with as many neighbours are one matrix
                at = (np.cumsum(n) - n)[n == size][:, None] + np.arange(size)
                w = _memberships(d[at], k)
                ids = np.repeat(batch.column(0).to_numpy()[n == size], size)
                yield pa.RecordBatch.from_arrays([pa.array(ids), cells.field(0).take(pa.array(at.ravel())), pa.array(w.ravel())], ["row_index", "neighbour", "w"])

    one = lists.mapInArrow(run, "row_index long, neighbour long, w double")
    both = one.unionByName(one.select(F.col("neighbour").alias("row_index"), F.col("row_index").alias("neighbour"), "w"))
    return both.groupBy("row_index", "neighbour").agg((F.sum("w") - F.when(F.count("*") > 1, F.product("w")).otherwise(0.0)).alias("weight"))


def _moved(x: np.ndarray, at: np.ndarray, there: np.ndarray, inside: np.ndarray, weight: np.ndarray, pool: np.ndarray, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Positions after STEPS steps: edge e pulls row at[e] towards there[e], or towards where the row inside[e] of the block now is; strangers push."""
    share = weight / weight.max(initial=1e-12)
    for step in range(STEPS):
        speed = rate * (1 - step / STEPS)
        on = rng.random(len(at)) < share
        a, target = at[on], np.where((inside[on] >= 0)[:, None], x[np.maximum(inside[on], 0)], there[on])
        diff = x[a] - target
        d2 = (diff * diff).sum(1)
        pull = -2 * CURVE_A * CURVE_B * d2 ** (CURVE_B - 1) / (1 + CURVE_A * d2**CURVE_B) if len(d2) else d2
        pulled = np.clip(np.where(d2 > 0, pull, 0.0)[:, None] * diff, -4, 4)
        others = np.repeat(a, STRANGERS)
        diff = x[others] - pool[rng.integers(0, len(pool), len(others))]
        d2 = (diff * diff).sum(1)
        push = 2 * CURVE_B / ((0.001 + d2) * (1 + CURVE_A * d2**CURVE_B))
        every, by = np.concatenate([a, others]), np.concatenate([pulled, np.clip(push[:, None] * diff, -4, 4)])
        move = np.stack([np.bincount(every, by[:, c], len(x)) for c in (0, 1)], axis=1)
        x = x + speed * np.clip(move, -4, 4)
    return x


def _mover(turn: int, rate: float, pool: Broadcast, seed: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What moves the rows of a block, given the edges from them with the places of the other ends."""

    def run(rows: pd.DataFrame, pulls: pd.DataFrame) -> pd.DataFrame:
        rows, pulls = rows.sort_values("row_index"), pulls.sort_values(["row_index", "neighbour"])
        ids, there, x = rows["row_index"].to_numpy(), pulls["neighbour"].to_numpy(), rows[["x", "y"]].to_numpy()
        if len(rows) and len(pulls):
            near = np.minimum(np.searchsorted(ids, there), len(ids) - 1)
            rng = np.random.default_rng((seed, turn, int(rows["block"].iloc[0])))
            x = _moved(x, np.searchsorted(ids, pulls["row_index"].to_numpy()), pulls[["tx", "ty"]].to_numpy(), np.where(ids[near] == there, near, -1), pulls["weight"].to_numpy(), pool.value, rate, rng)
        return pd.DataFrame({"row_index": ids, "x": x[:, 0], "y": x[:, 1]})

    return run


def layout(graph: DataFrame, start: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    """(row_index, x, y): rows of ``start`` (row_index, x, y) moved so that the neighbours of ``knn_graph`` come near each other and strangers apart."""
    edges = scratch.written(fuzzy_union(graph, k), "fuzzy")
    box = start.agg(*[f(c) for c in "xy" for f in (F.min, F.max)]).first()
    if box[0] is None:
        return start
    size = max(box[1] - box[0], box[3] - box[2], 1e-12)
    now = scratch.written(start.select("row_index", *[((F.col(c) - lo) * 20 / size - 10).alias(c) for c, lo in (("x", box[0]), ("y", box[2]))]), "places")
    blocks = max(1, -(-now.count() // LAYOUT_BLOCK))
    context = start.sparkSession.sparkContext
    for turn in range(LAYOUT_ROUNDS):
        pool = context.broadcast(now.orderBy(F.xxhash64(F.lit(turn), "row_index")).limit(POOL).select("x", "y").toPandas().to_numpy())
        rate = 1.0 - turn / LAYOUT_ROUNDS
        block = F.pmod(F.xxhash64(F.lit(turn), "row_index"), F.lit(blocks)).alias("block")
        far = edges.join(now.select(F.col("row_index").alias("neighbour"), F.col("x").alias("tx"), F.col("y").alias("ty")), "neighbour").select(block, "row_index", "neighbour", "tx", "ty", "weight")

        then = scratch.written(now.select(block, "row_index", "x", "y").groupBy("block").cogroup(far.groupBy("block")).applyInPandas(_mover(turn, rate, pool, seed), "row_index long, x double, y double"), "places")
        scratch.drop(now)
        now = then
    return now
