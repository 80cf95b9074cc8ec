"""Near-duplicate vectors by an inverted multi-index.

The two halves of a unit vector have a codebook each; a pair of codewords is a
cell of their product grid, and every vector lies in the cell of its nearest
codewords. To find its neighbours a vector walks the two sequences of codewords,
sorted by distance, along their frontier: it visits all cells that are at most
``slack`` farther than its own. The slack is what finds TARGET of pairs made at
the least cosine that links, from either of their ends, on a bounded sample.
In each visited cell the exact cosine decides.

Equal vectors are one class with a count. A cell is a group of its vectors and
visitors, cut into blocks of bounded size on either side; a block returns link
counts by vector and a star for each cluster, never pairs. Distances to codewords
are of whole numbers, so that both ends of a pair agree on who visits whom.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lookup, materialize, read, whole_keys
from .graph import connected_components

COSINE = 0.95
#: Vectors that the codebooks and the slack are fitted on at most; vectors of a cell on average; codewords of a half at most; share of the sample's pairs to be found.
SAMPLE, OCCUPANCY, CODEWORDS, TARGET = 16_384, 32, 512, 0.99
#: Rows of one side of a block on average, visitors compared at once, rows of an emitted batch, steps of the fit.
BLOCK, VISITORS, EMIT, STEPS = 4_096, 512, 8_192, 10
#: Whole numbers stand for components times this.
GRAIN = 4_096.0
#: Cosines nearer to the threshold are added up anew in an order that both ends share.
BORDER = 1e-12


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one, shorter ones filled up with zeros; scaled first, so that no square overflows."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = np.zeros((len(column), width))
    x[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    x /= np.abs(x).max(1, initial=0.0)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


class Grid:
    """Two codebooks and the slack of the traversal."""

    def __init__(self, first: np.ndarray, second: np.ndarray, slack: float):
        self.books, self.half, self.slack = (first, second), first.shape[1], slack

    def distances(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of either half to its codewords, exact whole numbers."""
        q = np.round(u * GRAIN)
        return tuple((h * h).sum(1)[:, None] + (c * c).sum(1) - 2.0 * (h @ c.T) for h, c in zip((q[:, : self.half], q[:, self.half :]), self.books, strict=True))

    def visits(self, d: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the traversal of each row: rank by rank of the first sequence, as far down the second as the bound allows."""
        order = [np.argsort(x, axis=1, kind="stable") for x in d]
        near = [np.take_along_axis(x, o, 1) for x, o in zip(d, order, strict=True)]
        room = near[0][:, 0] + near[1][:, 0] + self.slack
        k = near[1].shape[1]
        rows, cells, active = [], [], np.arange(len(room))
        for rank in range(near[0].shape[1]):
            active = active[near[0][active, rank] + near[1][active, 0] <= room[active]]
            if not len(active):
                break
            deep = (near[0][active, rank][:, None] + near[1][active] <= room[active][:, None]).sum(1)
            at = np.repeat(active, deep)
            along = np.arange(len(at)) - np.repeat(np.cumsum(deep) - deep, deep)
            rows.append(at)
            cells.append(order[0][at, rank] * k + order[1][at, along])
        return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(cells or [np.zeros(0, np.int64)])


def _codebook(h: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means in whole numbers; a codeword without vectors stays."""
    c = h[rng.permutation(len(h))[:k]]
    for _ in range(STEPS):
        own = ((c * c).sum(1) - 2.0 * (h @ c.T)).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, h)
        c = np.where(n[:, None] > 0, np.round(sums / np.maximum(n, 1)[:, None]), c)
    return c


def fit_grid(u: np.ndarray, n: int, least: float, target: float = TARGET) -> Grid:
    """The grid for n vectors, fitted on the sample ``u`` of them.

    The pairs that fix the slack join a sampled vector with one at cosine
    ``least`` from it, half of them in a random direction, half towards another sampled vector.
    """
    rng = np.random.default_rng(0)
    half = u.shape[1] // 2
    k = max(1, min(CODEWORDS, len(u), math.ceil(math.sqrt(n / OCCUPANCY))))
    q = np.round(u * GRAIN)
    grid = Grid(_codebook(q[:, :half], k, rng), _codebook(q[:, half:], k, rng), 0.0)
    slack = 0.0
    for away in (rng.normal(size=u.shape), u[rng.permutation(len(u))]):
        away = away - (away * u).sum(1)[:, None] * u
        size = np.sqrt((away * away).sum(1))
        some = size > 1e-6
        if some.any():
            x = u[some]
            y = least * x + math.sqrt(1 - least**2) * away[some] / size[some][:, None]
            a, b = grid.distances(x), grid.distances(y)
            rows, homes = np.arange(len(x)), [[m.argmin(1) for m in d] for d in (a, b)]
            ways = [sum(m[rows, h] - m.min(1) for m, h in zip(d, homes[1 - i], strict=True)) for i, d in enumerate((a, b))]
            slack = max(slack, float(np.quantile(np.minimum(*ways), target)))
    return Grid(*grid.books, slack)


def _cell_sizes(classes: DataFrame, grid, width: int) -> dict[int, tuple[int, int]]:
    """Blocks of vectors and of visitors of the cells that need more than one: no more rows than the grid has cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grid.value
        k = len(g.books[1])
        own, seen = np.zeros(len(g.books[0]) * k, np.int64), np.zeros(len(g.books[0]) * k, np.int64)
        for batch in batches:
            d = g.distances(_unit(batch.column(0), width))
            own += np.bincount(d[0].argmin(1) * k + d[1].argmin(1), minlength=len(own))
            seen += np.bincount(g.visits(d)[1], minlength=len(seen))
        cells = np.flatnonzero(own + seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(own[cells]), pa.array(seen[cells])], ["cell", "own", "seen"])

    sums = classes.select("v").mapInArrow(run, "cell long, own long, seen long").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("seen").alias("seen"))
    return {r.cell: (-(-r.own // BLOCK) or 1, -(-r.seen // BLOCK) or 1) for r in sums.where(F.greatest("own", "seen") > BLOCK).collect()}


def _dealt(classes: DataFrame, grid, sizes: dict[int, tuple[int, int]], width: int) -> DataFrame:
    """(key, visitor, node, weight, u): each vector in its cell and as a visitor, once for every block of the other side."""
    blocks = classes.sparkSession.sparkContext.broadcast(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, cut = grid.value, blocks.value
        k = len(g.books[1])
        counts = np.ones((len(g.books[0]) * k, 2), np.int64)
        for cell, n in cut.items():
            counts[cell] = n
        for batch in batches:
            u = _unit(batch.column(2), width)
            d = g.distances(u)
            node, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            deal = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for visitor, (rows, cells) in enumerate(((np.arange(len(u)), d[0].argmin(1) * k + d[1].argmin(1)), g.visits(d))):
                mine, theirs = counts[cells, visitor], counts[cells, 1 - visitor]
                ends = np.cumsum(theirs)
                for at in range(0, int(ends[-1]) if len(ends) else 0, EMIT):
                    slot = np.arange(at, min(at + EMIT, int(ends[-1])))
                    of = np.searchsorted(ends, slot, "right")
                    other = slot - (ends - theirs)[of]
                    own = deal[rows[of]] % mine[of]
                    key = cells[of] << 42 | np.where(visitor, other, own) << 21 | np.where(visitor, own, other)
                    row = rows[of]
                    vectors = pa.array([x.tobytes() for x in u[row]], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), visitor)), pa.array(node[row]), pa.array(weight[row]), vectors], ["key", "visitor", "node", "weight", "u"])

    return classes.select("node", "n", "v").mapInArrow(run, "key long, visitor long, node long, weight long, u binary")


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each row's least joined row, after joining the rows a with the rows b."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent != (above := parent[parent])).any():
            parent = above
        labels = parent[labels]


def _links(u: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    s = u @ x.T
    hit = s >= least
    for i, j in np.argwhere(np.abs(s - least) < BORDER):
        hit[i, j] = (u[i] * x[j]).sum() >= least
    return hit


def _compared(rows: DataFrame, grid, least: float) -> DataFrame:
    """(node, n, other): links found of a node, or (with n 0) a link of the star of its cluster, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grid.value
        for _, visitor, node, weight, blobs in whole_keys(batches):
            u = np.frombuffer(b"".join(blobs), np.float64).reshape(len(node), -1)
            v, x = np.flatnonzero(visitor == 1), np.flatnonzero(visitor == 0)
            if not len(v) or not len(x):
                continue
            links, labels = np.zeros(len(node), np.int64), np.arange(len(node))
            d = g.distances(u)
            homes = [m.argmin(1) for m in d]
            room = sum(m.min(1) for m in d) + g.slack
            for at in range(0, len(v), VISITORS):
                mine = v[at : at + VISITORS]
                i, j = np.nonzero(_links(u[mine], u[x], least) & (node[mine][:, None] != node[x][None, :]))
                if not len(i):
                    continue
                a, b = mine[i], x[j]
                # A pair whose other end doesn't visit is counted for both of them here.
                alone = d[0][b, homes[0][a]] + d[1][b, homes[1][a]] > room[b]
                np.add.at(links, a, weight[b])
                np.add.at(links, b[alone], weight[a[alone]])
                labels = _join(labels, a, b)
            some, joined = links > 0, labels != np.arange(len(labels))
            out = [np.concatenate(p) for p in ((node[some], node[joined]), (links[some], np.zeros(int(joined.sum()), np.int64)), (node[some], node[labels[joined]]))]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in out], ["node", "n", "other"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "node long, n long, other long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE, target: float = TARGET) -> DataFrame:
    """(id, n_links, component_id, kept) per row: other vectors linked at cosine ``least`` or more, the smallest id reachable, whether that is the row's own.

    Every link is exact; the share that is found is near ``target`` or above. A
    vector that is null, empty, zero or holds a null or non-finite component links with
    nothing. Shorter vectors count as filled up with zeros. Repeated rows all
    return and link with each other; a row with a null id links like any
    other, but its component is named after an id if there is one. An empty
    table gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    named = rows.where("fine").withColumns({"ha": F.xxhash64(F.lit(1), "v"), "hb": F.xxhash64(F.lit(2), "v")})
    grouped = named.groupBy("ha", "hb").agg(F.min("id").alias("least_id"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    total, n, width = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    sample = _unit(classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks(), width) if total else np.ones((1, width))
    grid = spark.sparkContext.broadcast(fit_grid(sample, total, least, target))
    found = materialize(_compared(_dealt(classes, grid, _cell_sizes(classes, grid, width), width), grid, least), "found")
    parts = connected_components(found.where("n = 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("links"))
    judged = classes.drop("v").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    judged = materialize(judged.select("ha", "hb", "n", "least_id", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "judged")
    names = materialize(judged.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members")), "names")
    many = max(64, n // 1000)
    answers = lookup(judged, names, ["component"], F.col("members") > many).select("ha", "hb", "n", "n_links", "component_id")
    answers = materialize(answers, "answers")
    for table in (classes, found, parts, judged, names):
        discard(table)
    linked = lookup(named.select("id", "ha", "hb"), answers, ["ha", "hb"], F.col("n") > many).select("id", "n_links", "component_id")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 or more among all embeddings, whatever their labels."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
WITH RECURSIVE vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a, vecs b WHERE a.fine AND b.fine AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM vecs UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM vecs JOIN least USING (vec_id)"""
