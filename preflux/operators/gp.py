"""Exact Gaussian-process preference model: fit where the ratings fit, scoring where the candidates are.

The ratings that one person gives are few, so up to DRIVER_RATINGS the fit is
numpy on the driver and its state is broadcast: candidates never move, one
narrow stage multiplies each Arrow batch with it. Beyond that the kernel matrix
is a table of tiles (``tiles``). ``noise`` is a standard deviation; the variance
is that of the latent function.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V

if TYPE_CHECKING:
    from . import tiles

#: Ratings that the driver fits: their factor, broadcast with the state, takes 128 MiB at most.
DRIVER_RATINGS = 4_096
#: Bytes of query vectors that one pass over all vectors takes along.
WAVE_BYTES = 64 << 20
#: Cells of a matrix of pairs that are worked out and handed on at once, and those that a task returns, about 50 MB in parquet.
PAIR_CELLS, TASK_PAIRS = 1 << 20, 1 << 23
#: The box of the hyperparameter search.
BOX = {"length_scale": (1e-3, 10.0), "variance": (1e-4, 10.0), "noise": (1e-5, 1.0)}


@dataclass(frozen=True)
class GPState:
    x: np.ndarray
    y: np.ndarray
    alpha: np.ndarray
    inverse_factor: np.ndarray | None
    length_scale: float
    variance: float
    noise: float
    lml: float
    optimization: dict = field(default_factory=dict)
    ids: np.ndarray | None = None

    @property
    def m(self) -> int:
        return len(self.y)

    @property
    def best(self) -> float:
        return float(self.y.max())


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def kernel(a: np.ndarray, b: np.ndarray, length_scale: float, variance: float) -> np.ndarray:
    if length_scale <= 0 or variance <= 0:
        raise ValueError("length_scale and variance must be positive")
    return variance * np.exp(-squared_distances(a, b) / (2.0 * length_scale**2))


def lower_solve(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of low @ x = b by halves: work that follows the square of the size, in BLAS products."""
    n = len(low)
    if n <= 64:
        return np.linalg.solve(low, b)
    h = n // 2
    top = lower_solve(low[:h, :h], b[:h])
    return np.concatenate([top, lower_solve(low[h:, h:], b[h:] - low[h:, :h] @ top)])


def lower_inverse(low: np.ndarray) -> np.ndarray:
    n = len(low)
    if n <= 64:
        return np.tril(np.linalg.inv(low))
    h = n // 2
    a, d = lower_inverse(low[:h, :h]), lower_inverse(low[h:, h:])
    return np.block([[a, np.zeros((h, n - h))], [-d @ (low[h:, :h] @ a), d]])


def upper_solve(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of low.T @ x = b: the lower case read backwards."""
    return lower_solve(low.T[::-1, ::-1], b[::-1])[::-1]


def _factor(x: np.ndarray, y: np.ndarray, params: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, float]:
    length_scale, variance, noise = params
    k = kernel(x, x, length_scale, variance) + noise**2 * np.eye(len(x))
    low = np.linalg.cholesky(k)
    alpha = upper_solve(low, lower_solve(low, y))
    lml = -0.5 * float(y @ alpha) - float(np.log(np.diag(low)).sum()) - 0.5 * len(y) * math.log(2 * math.pi)
    return low, alpha, lml


def lml_gradient(x: np.ndarray, y: np.ndarray, params: tuple[float, float, float]) -> np.ndarray:
    """Derivatives of the log marginal likelihood by length scale, variance and noise."""
    length_scale, variance, noise = params
    low, alpha, _ = _factor(x, y, params)
    inverse = lower_inverse(low)
    inverse = inverse.T @ inverse
    k = kernel(x, x, length_scale, variance)
    d2 = -2.0 * length_scale**2 * np.log(np.maximum(k / variance, 1e-300))
    w = np.outer(alpha, alpha) - inverse
    return 0.5 * np.array([(w * (k * d2 / length_scale**3)).sum(), (w * (k / variance)).sum(), 2.0 * noise * np.trace(w)])


def optimize(x: np.ndarray, y: np.ndarray, start: tuple[float, float, float], steps: int = 50) -> tuple[tuple[float, float, float], dict]:
    """Projected quasi-Newton ascent in log space inside BOX; the start stays if nothing is better."""
    low, high = (np.log(np.array(v)) for v in zip(*BOX.values(), strict=True))

    def value(z: np.ndarray) -> float:
        try:
            return -_factor(x, y, tuple(np.exp(z)))[2]
        except np.linalg.LinAlgError:
            return 1e12

    def slope(z: np.ndarray) -> np.ndarray:
        p = np.exp(z)
        return -lml_gradient(x, y, tuple(p)) * p

    z = np.clip(np.log(np.array(start)), low, high)
    f, g, h = value(z), slope(z), np.eye(3)
    first, done = f, 0
    for done in range(1, steps + 1):
        free = ~(((z <= low) & (g > 0)) | ((z >= high) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-6:
            break
        direction = -(h @ (g * free)) * free
        if direction @ g >= 0:
            h, direction = np.eye(3), -g * free
        t, moved = 1.0, False
        while t > 1e-10:
            nxt = np.clip(z + t * direction, low, high)
            fn = value(nxt)
            if fn <= f + 1e-4 * g @ (nxt - z) and fn < f:
                moved = True
                break
            t *= 0.5
        if not moved:
            break
        gn = slope(nxt)
        s, d = nxt - z, gn - g
        if s @ d > 1e-12:
            r = 1.0 / (s @ d)
            left = np.eye(3) - r * np.outer(s, d)
            h = left @ h @ left.T + r * np.outer(s, s)
        z, f, g = nxt, fn, gn
    return tuple(np.exp(z).tolist()), {"start_lml": -first, "lml": -f, "iterations": done, "improved": f < first}


def optimize_simplex(value: Callable[[tuple[float, float, float]], float], start: tuple[float, float, float], steps: int = 200, tolerance: float = 1e-6) -> tuple[tuple[float, float, float], dict]:
    """Unbounded Nelder and Mead ascent of a log likelihood over the logarithms of (length scale, variance, noise); needs no derivative, so any fit will do.

    A point where the matrix isn't positive definite counts as lowest. The start stays if nothing is better.
    """

    def cost(z: np.ndarray) -> float:
        try:
            found = -value(tuple(np.exp(z).tolist()))
        except (np.linalg.LinAlgError, OverflowError, ValueError):
            return math.inf
        return found if math.isfinite(found) else math.inf

    origin = np.log(np.array(start, float))
    points = np.stack([origin, *(origin + 0.5 * unit for unit in np.eye(len(origin)))])
    costs = np.array([cost(z) for z in points])
    first, done = costs[0], 0
    for done in range(1, steps + 1):
        rank = np.argsort(costs, kind="stable")
        points, costs = points[rank], costs[rank]
        if np.abs(points[1:] - points[0]).max() < tolerance or costs[-1] - costs[0] < tolerance**2 * max(1.0, abs(costs[0])):
            break
        centre = points[:-1].mean(0)

        def along(t: float) -> tuple[np.ndarray, float]:
            z = centre + t * (centre - points[-1])
            return z, cost(z)

        z, f = along(1.0)
        if f < costs[0]:
            further, better = along(2.0)
            if better < f:
                z, f = further, better
        elif f >= costs[-2]:
            z, f = along(0.5 if f < costs[-1] else -0.5)
            if f >= costs[-1]:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                costs[1:] = [cost(p) for p in points[1:]]
                continue
        points[-1], costs[-1] = z, f
    best = int(np.argmin(costs))
    return tuple(np.exp(points[best]).tolist()), {"start_lml": -float(first), "lml": -float(costs[best]), "iterations": done, "improved": bool(costs[best] < first)}


def likelihood(x: np.ndarray, y: np.ndarray, params: tuple[float, float, float]) -> float:
    return _factor(x, y, params)[2]


def fit(x: np.ndarray, y: np.ndarray, length_scale: float = 1.0, variance: float = 1.0, noise: float = 1e-3, with_variance: bool = True, optimize_hyperparameters: bool = False, max_iterations: int = 50) -> GPState:
    x, y = np.asarray(x, float), np.asarray(y, float)
    if x.ndim != 2 or y.ndim != 1 or len(x) != len(y) or not len(x):
        raise ValueError("x must be a matrix with as many rows as y has values, one at least")
    if noise <= 0:
        raise ValueError("noise must be positive")
    params, info = (length_scale, variance, noise), {}
    if optimize_hyperparameters:
        if len(x) < 2:
            raise ValueError("a hyperparameter search needs two ratings at least")
        params, info = optimize(x, y, params, max_iterations)
    low, alpha, lml = _factor(x, y, params)
    return GPState(x, y, alpha, lower_inverse(low) if with_variance else None, *params, lml, info)


def posterior(state: GPState, q: np.ndarray, with_variance: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    k = kernel(q, state.x, state.length_scale, state.variance)
    mean = k @ state.alpha
    if not with_variance:
        return mean, None
    if state.inverse_factor is None:
        raise ValueError("the state was fitted without its factor, so it has no variance")
    half = k @ state.inverse_factor.T
    return mean, np.maximum(state.variance - (half * half).sum(1), 0.0)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def fit_frame(rated: DataFrame, with_weights: bool = True, **options) -> GPState | tiles.TiledState:
    """Fit from (row_index, e, rating), on the driver up to DRIVER_RATINGS rows and as a table of tiles above; ``with_weights`` may be left out where the likelihood alone is asked for."""
    table = rated.select("row_index", "e", "rating").orderBy("row_index").limit(DRIVER_RATINGS + 1).toPandas()
    if len(table) > DRIVER_RATINGS:
        return _fit_tiled(rated, with_weights, **options)
    return replace(fit(matrix(table["e"]), table["rating"].to_numpy(float), **options), ids=table["row_index"].to_numpy(np.int64))


def _fit_tiled(rated: DataFrame, with_weights: bool = True, length_scale: float = 1.0, variance: float = 1.0, noise: float = 1e-3, with_variance: bool = True, optimize_hyperparameters: bool = False, max_iterations: int = 50) -> tiles.TiledState:
    """The inverse factor is made only for a variance; a search evaluates likelihoods alone."""
    from . import tiles

    params, info = (length_scale, variance, noise), {}
    if optimize_hyperparameters:
        params, info = optimize_simplex(lambda p: tiles.likelihood(rated, *p), params, max_iterations)
    return replace(tiles.fit(rated, *params, inverse=with_variance, weights=with_weights), optimization=info)


def alpha_frame(spark: SparkSession, state: GPState | tiles.TiledState) -> DataFrame:
    """(row_index, alpha) of a state that ``fit_frame`` made."""
    if not isinstance(state, GPState):
        return state.alpha
    return spark.createDataFrame(zip(state.ids.tolist(), state.alpha.tolist(), strict=True), "row_index long, alpha double")


def pairs(vectors: DataFrame, queries: DataFrame, name: str, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(row_index, rated_index, name) of every vector and each of the queries (row_index, e): one matrix product per batch.

    Queries go along in waves of WAVE_BYTES on average, each in one pass over the vectors; only the pairs themselves grow with both.
    Vectors are dealt out by the number of their pairs, however few files hold them, so a task returns TASK_PAIRS or so at every size.
    """
    n, width = queries.agg(F.count("*"), F.sum(F.size("e"))).first()
    waves = max(1, -(-(width or 0) * 8 // WAVE_BYTES))
    found = vectors.count() * -(-n // waves)
    tasks = max(-(-found // TASK_PAIRS), min(-(-found // PAIR_CELLS), vectors.sparkSession.sparkContext.defaultParallelism))
    spread = vectors.select("row_index", "e").repartition(max(1, tasks))
    dealt = queries.select("row_index", "e", F.pmod(F.xxhash64("row_index"), F.lit(waves)).alias("wave"))
    parts = [_wave_pairs(spread, dealt.where(F.col("wave") == w).orderBy("row_index").toPandas(), name, value) for w in range(waves)]
    return reduce(DataFrame.unionByName, parts)


def _wave_pairs(vectors: DataFrame, table: pd.DataFrame, name: str, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The pairs of one wave. A block's go out by value: equal values then lie side by side, and a file takes half the bytes."""
    shared = vectors.sparkSession.sparkContext.broadcast((table["row_index"].to_numpy(np.int64), matrix(table["e"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, y = shared.value
        m = len(index)
        rows, block = (max(1, cells // max(1, m)) for cells in (PAIR_CELLS, 2 * TASK_PAIRS))
        for whole in batches:
            for b in (whole.slice(at, block) for at in range(0, len(whole) if m else 0, block)):
                x, ids = V.batch_matrix(b.column(1)), b.column(0).to_numpy()
                cells = np.empty((len(b), m))
                for at in range(0, len(b), rows):
                    cells[at : at + rows] = value(x[at : at + rows], y)
                order, cells = np.argsort(cells, axis=None), cells.ravel()
                for at in range(0, len(order), PAIR_CELLS):
                    o = order[at : at + PAIR_CELLS]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[o // m]), pa.array(index[o % m]), pa.array(cells[o])], ["row_index", "rated_index", name])

    return vectors.mapInArrow(run, f"row_index long, rated_index long, {name} double")


def score(candidates: DataFrame, state: GPState | tiles.TiledState, mean: bool = True, variance: bool = True, block_rows: int = 2048) -> DataFrame:
    """``candidates`` (row_index, e) with mean and variance, ``block_rows`` at a time; a column that is not asked for is not computed."""
    if not isinstance(state, GPState):
        from . import tiles

        return tiles.score(candidates, state, mean, variance)
    shared = candidates.sparkSession.sparkContext.broadcast(state)
    names = ["mean"] * mean + ["variance"] * variance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, block_rows) for at in range(0, len(whole), block_rows)):
                q = V.batch_matrix(b.column(1))
                values = dict(zip(("mean", "variance"), posterior(shared.value, q, variance), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(values[n]) for n in names)], ["row_index", *names])

    return candidates.select("row_index", "e").mapInArrow(run, ", ".join(["row_index long", *(f"{n} double" for n in names)]))


def score_by_row(candidates: DataFrame, state: GPState) -> DataFrame:
    """The same numbers one candidate at a time, distances from differences: the independent check of ``score`` at every size that the driver fits."""
    if not isinstance(state, GPState):
        raise ValueError("a tiled state is scored by panels alone")
    if state.inverse_factor is None:
        raise ValueError("the state was fitted without its factor, so it has no variance")
    shared = candidates.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            mean, variance = np.zeros(len(batch)), np.zeros(len(batch))
            for at, q in enumerate(V.batch_matrix(batch.column(1)) if len(batch) else ()):
                k = s.variance * np.exp(-((s.x - q) ** 2).sum(1) / (2.0 * s.length_scale**2))
                half = s.inverse_factor @ k
                mean[at], variance[at] = k @ s.alpha, max(s.variance - half @ half, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean), pa.array(variance)], ["row_index", "mean", "variance"])

    return candidates.select("row_index", "e").mapInArrow(run, "row_index long, mean double, variance double")


def score_by_expression(candidates: DataFrame, state: GPState) -> DataFrame:
    """The same numbers by column expressions alone, the state as one broadcast row: the independent check, and the small-m path without Python."""
    if not isinstance(state, GPState):
        raise ValueError("a tiled state has no broadcast form")
    held = candidates.sparkSession.createDataFrame([(state.x.tolist(), state.inverse_factor.tolist(), state.alpha.tolist())], "x array<array<double>>, factor array<array<double>>, alpha array<double>")
    k = F.transform("x", lambda r: state.variance * F.exp(-V.squared_distance(F.col("e"), r) / (2.0 * state.length_scale**2)))
    half = F.transform("factor", lambda r: V.dot(F.col("k"), r))
    return candidates.select("row_index", "e").crossJoin(F.broadcast(held)).withColumn("k", k).select(
        "row_index", V.dot(F.col("k"), F.col("alpha")).alias("mean"), F.greatest(F.lit(state.variance) - V.squared_norm(half), F.lit(0.0)).alias("variance")
    )
