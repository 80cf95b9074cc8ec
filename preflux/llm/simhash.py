"""SimHash near-duplicates found with vantage-point trees.

Two fingerprints that differ in at most four bits agree in u of 4 + u parts of
the 64, so rows are dealt to a group for each choice of u parts, by low bits of these; as many
bits as leave ``GROUP_ROWS`` rows a group on average, none for a small table, and u as small as gives so many.
This only spreads the search. Inside a group a vantage-point tree finds the
links: each node splits its rows by their Hamming distance from a vantage
point, and a batch of queries goes down to a child only where the triangle
inequality allows a hit there. A group above ``SHARD_ROWS`` is first cut into
shards by vantage points, rows near the boundary going to both sides, and each
shard has its own tree. Rows that are joined already aren't compared again, so
a dense cluster costs about its size, and a shard returns a star for each of
its clusters instead of all pairs. Every link is an exact Hamming comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read, whole_keys
from .graph import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Parts that are left untouched, at most: enough for 32 bits of key, which deal 8 * 10**12 fingerprints.
UNTOUCHED = 4
#: Rows of a group on average, rows from which a group is cut into shards, and the share of its rows that a shard may hold at most (a tighter cluster stays whole).
GROUP_ROWS, SHARD_ROWS, SHARD_SHARE = 2_000, 20_000, 0.9
#: Rows of a leaf at most, and queries that go down a tree together.
LEAF, QUERIES = 64, 4_096


def fingerprint(text: str) -> int:
    """The text's fingerprint as a signed 64-bit number; no words: zero."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        h = np.array([digest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - SHINGLE + 1].tolist()
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) per row; a null text counts as one without words."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Node:
    """Rows order[start:end] of a tree; an inner node has a vantage point and, for each child, the range of its distances."""

    __slots__ = ("start", "end", "vantage", "children", "ranges")

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end
        self.vantage, self.children, self.ranges = np.uint64(0), (), ()


class VantageTree:
    """Classes of the fingerprints of one shard, over links of at most RADIUS bits.

    ``labels`` has for each row the least row known to be joined with it;
    ``visits`` counts the nodes that queries have come to, ``compared`` the
    pairs that leaves have compared.
    """

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.labels = np.arange(len(fps))
        self.order = np.arange(len(fps))
        self.visits = self.compared = 0
        self.root = Node(0, len(fps))
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.end - node.start > LEAF:
                self._split(node)
                todo += node.children

    def _split(self, node: Node) -> None:
        rows = self.order[node.start : node.end]
        node.vantage = self.fps[rows[0]]
        d = _distance(self.fps[rows], node.vantage)
        near = rows[d <= RADIUS]
        self._join(near, np.full(len(near), rows[0]))
        middle = min(int(np.median(d)), int(d.max()) - 1)
        rank = np.argsort(d, kind="stable")
        self.order[node.start : node.end], d = rows[rank], d[rank]
        cut = int(np.searchsorted(d, middle, "right"))
        node.children = Node(node.start, node.start + cut), Node(node.start + cut, node.end)
        node.ranges = (d[0], d[cut - 1]), (d[cut], d[-1])

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.labels[a], self.labels[b]
            apart = x != y
            if not apart.any():
                return
            parent = np.arange(len(self.fps))
            np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (parent != (above := parent[parent])).any():
                parent = above
            self.labels = parent[self.labels]

    def search(self) -> np.ndarray:
        """All rows are queries; returns their labels."""
        for at in range(0, len(self.fps), QUERIES):
            todo = [(self.root, self.order[at : at + QUERIES])]
            while todo:
                node, queries = todo.pop()
                labels = self.labels[self.order[node.start : node.end]]
                if (labels == labels[0]).all():
                    queries = queries[self.labels[queries] != labels[0]]  # the others are joined with all of it
                if not len(queries):
                    continue
                self.visits += len(queries)
                if not node.children:
                    self._leaf(node, queries)
                    continue
                d = _distance(self.fps[queries], node.vantage)
                for child, (low, high) in zip(node.children, node.ranges, strict=True):
                    reach = queries[(d + RADIUS >= low) & (d - RADIUS <= high)]
                    if len(reach):
                        todo.append((child, reach))
        return self.labels

    def _leaf(self, node: Node, queries: np.ndarray) -> None:
        rows = self.order[node.start : node.end]
        self.compared += len(queries) * len(rows)
        near = np.bitwise_count(self.fps[queries][:, None] ^ self.fps[rows][None, :]) <= RADIUS
        near &= self.labels[queries][:, None] != self.labels[rows][None, :]
        if near.any():
            x, y = np.nonzero(near)
            self._join(queries[x], rows[y])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, node) sorted by key: a star of each cluster of each key's rows."""
    for _, fps, nodes in whole_keys(batches):
        labels = VantageTree(fps.view(np.uint64)).search()
        joined = labels != np.arange(len(labels))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[joined]), pa.array(nodes[labels[joined]])], ["a", "b"])


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, fps, _ in whole_keys(batches):
        tree = VantageTree(fps.view(np.uint64))
        tree.search()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (keys[0], len(fps), tree.visits, tree.compared)], ["key", "n", "visits", "compared"])


def _cut_hot_groups(rows: DataFrame, most: int) -> DataFrame:
    """Groups of more than ``most`` rows cut into shards by a vantage point, until none is left that can be cut.

    With m the median distance, rows up to m + RADIUS / 2 go to the inner shard
    and rows above m - RADIUS / 2 to the outer one: two rows of a link differ by
    RADIUS at most in their distances, so one shard has both. A side has no more than
    SHARD_SHARE of its group's rows, so the levels follow the logarithm of the largest group.
    """
    half, before = RADIUS // 2, None
    while True:
        hot = rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp")).alias("v")).where(F.col("n") > most)
        far = rows.join(hot, "key").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))))
        middle = far.groupBy("key").agg(F.percentile_approx("d", 0.5).alias("m"))
        inner, outer = F.col("d") <= F.col("m") + half, F.col("d") > F.col("m") - half
        sizes = far.join(middle, "key").groupBy("key", "v", "m").agg(F.count("*").alias("n"), F.count_if(inner).alias("i"), F.count_if(outer).alias("o"))
        cuts = materialize(sizes.where(F.greatest("i", "o") <= SHARD_SHARE * F.col("n")).select("key", "v", "m"), "cuts")
        if cuts.isEmpty():
            discard(cuts)
            return rows
        sides = F.array_compact(F.array(F.when(inner, 0), F.when(outer, 1)))
        shards = rows.join(cuts, "key").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))).withColumn("side", F.explode(sides))
        rows = materialize(rows.join(cuts, "key", "left_anti").unionByName(shards.select(F.xxhash64("key", "side").alias("key"), "fp", "node")), "shards")
        for table in (cuts, before):
            if table is not None:
                discard(table)
        before = rows


def group_keys(n: int) -> list[Column]:
    """The group keys of a fingerprint ``fp`` among n: one for each choice of untouched parts, or a single one for a small table."""
    bits = math.ceil(math.log2(n / GROUP_ROWS)) if n > GROUP_ROWS else 0
    if not bits:
        return [F.xxhash64(F.lit(0))]
    u = next((u for u in range(1, UNTOUCHED) if u * (64 // (RADIUS + u)) >= bits), UNTOUCHED)
    width = 64 // (RADIUS + u)
    low = F.lit((1 << min(width, -(-bits // u))) - 1)
    parts = [F.shiftrightunsigned("fp", i * width).bitwiseAND(low) for i in range(RADIUS + u)]
    return [F.xxhash64(F.lit(k), *chosen) for k, chosen in enumerate(combinations(parts, u))]


def search_groups(reps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, fp, node): the shards that the distinct fingerprints ``reps`` (fp, node) are searched in, sorted by key."""
    keys = F.array(*group_keys(reps.count()))
    rows = _cut_hot_groups(reps.select(F.explode(keys).alias("key"), "fp", "node"), shard_rows)
    # So many partitions whatever their bytes: a group costs more time than room.
    return rows.repartition(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")


def fingerprint_links(reps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links that span every cluster of the distinct fingerprints ``reps`` (fp, node)."""
    return search_groups(reps, shard_rows).mapInArrow(_search, "a long, b long").distinct()


def search_figures(reps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, n, visits, compared) per shard: its rows, node visits of its queries, and pairs compared (of n * n)."""
    return search_groups(reps, shard_rows).mapInArrow(_figures, "key long, n long, visits long, compared long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id_col, fp, component_id) per row; the component's smallest id, over links of at most RADIUS bits.

    Ids are integers. Texts without words (null, empty, blank) have
    fingerprint 0 and link like any other. A row with a null id takes the
    component of its fingerprint's other rows, or null. Repeated rows all
    return; an empty table gives no rows; other columns are not looked at.
    """
    fps = materialize(with_fingerprints(docs, id_col, text_col), "fingerprints")
    reps = materialize(fps.groupBy("fp").agg(F.min("id").alias("node")).where("node is not null"), "representatives")
    links = materialize(fingerprint_links(reps, shard_rows), "fingerprint-links")
    parts = connected_components(links)
    classes = materialize(reps.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "classes")
    for table in (reps, links, parts):
        discard(table)
    return fps.join(classes, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def op1_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
