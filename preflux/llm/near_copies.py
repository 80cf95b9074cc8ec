"""Near copies by word shingles: MinHash bands give candidates, exact Jaccard similarity decides.

SimHash can't find these pairs: at similarity 0.8 two 64-bit fingerprints differ
in about ten bits, and a radius that misses next to none of such pairs (twenty)
takes in a few of every thousand unrelated ones. A band is a run of ``ROWS``
MinHashes; there are as many bands as leave a miss chance of ``MISS`` at most
at the threshold.

Only links that join two components are worth testing. So the rows with an
equal band are first tested against one of them, which is found by an
aggregate. Bands whose rows that leaves in several components are then searched
whole, in blocks of ``BLOCK_ROWS`` rows against as many: no pair stays untested
unless its rows are joined already or a parity sketch rules it out. The sketch
has one bit for each bucket of the shingles, the parity of the set's shingles in
it; the bits that differ between two sketches are no more than the shingles
that one of the two sets lacks, so what it rules out is surely below 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, materialize, whole_keys
from .graph import connected_components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
ROWS, MISS = 4, 1e-7
BANDS = math.ceil(math.log(MISS) / math.log1p(-(SIMILARITY**ROWS)))
HASHES = BANDS * ROWS
#: Rows of a block, and words of sketches that are compared at once.
BLOCK_ROWS, CELLS = 4_096, 1 << 20

_random = np.random.default_rng(SEED)
_XOR = _random.integers(0, 1 << 64, HASHES, dtype=np.uint64)[:, None]
_TIMES = _random.integers(0, 1 << 64, HASHES, dtype=np.uint64)[:, None] | np.uint64(1)


def split_words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The set of the words' five-word runs, hashed; fewer words are one run, none are an empty set."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - SHINGLE + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    step = 1 << 12
    for a in range(0, len(shingles), step):
        np.minimum(out, ((shingles[None, a : a + step] ^ _XOR) * _TIMES).min(axis=1), out=out)
    return out


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bit i: the parity of the shingles whose hash ends in i; two to four bits a shingle, 64 at least."""
    bits = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray) -> np.ndarray:
    """The sketches with half as many bits of the same sets."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def _signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, n, bands, sketch) per row: digest of the words, size of the shingle set, bands (none without words), parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, n, bands, sketch = [], [], [], []
            for t in batch.column(1):
                words = split_words(t.as_py() or "")
                seq.append(xxhash.xxh3_128_digest(b" ".join(words)))
                shingles = shingle_hashes(words)
                rows = np.ascontiguousarray(minhashes(shingles).reshape(BANDS, ROWS))
                n.append(len(shingles))
                bands.append([xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)] if words else [])
                sketch.append(parity_sketch(shingles).tobytes())
            columns = [batch.column(0), pa.array(seq, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "seq", "n", "bands", "sketch"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, seq binary, n long, bands array<long>, sketch binary")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(split_words(t.as_py() or "")).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


class Block:
    """Rows of one band, by the width of their sketches and then by size."""

    def __init__(self, band: int, side: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, tags: np.ndarray):
        self.node, self.comp, self.n, self.side, self.band = node, comp, n, side, band
        self.tags = np.frombuffer(b"".join(tags), np.uint32).reshape(-1, BANDS)
        values, counts = np.unique(comp, return_counts=True)
        self.largest = values[counts.argmax()]
        width = np.fromiter(map(len, sketch), np.int64, len(sketch)) // 8
        order = np.lexsort((n, width))
        self.rows = {w: order[width[order] == w] for w in np.unique(width).tolist()}
        self.sketch = {w: np.frombuffer(b"".join(sketch[r]), np.uint64).reshape(-1, w) for w, r in self.rows.items()}

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs across components that the sketches don't rule out: rows outside the largest component, with any."""
        for w, rows in self.rows.items():
            outside = self.comp[rows] != self.largest
            for v in (w // 2, w, 2 * w):
                if v in self.rows and outside.any():
                    x, y = self.sketch[w][outside], self.sketch[v]
                    yield from self._compare(rows[outside], x if w <= v else folded(x), self.rows[v], y if v <= w else folded(y))

    def _compare(self, a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # Sets that differ more in size than four to five can't reach the threshold.
        low = np.searchsorted(5 * self.n[b], 4 * self.n[a], "left")
        counts = np.searchsorted(4 * self.n[b], 5 * self.n[a], "right") - low
        at = 0
        while at < len(a):
            total = np.cumsum(counts[at:])
            end = at + max(1, int(np.searchsorted(total, CELLS // x.shape[1], "right")))
            p = np.repeat(np.arange(at, end), counts[at:end])
            q = np.arange(len(p)) - np.repeat(np.r_[0, total[: end - at - 1]], counts[at:end]) + low[p]
            i, j = a[p], b[q]
            # Two blocks: a pair has a row of each. If both rows lie outside the largest component, the pair comes up twice.
            untold = (self.comp[i] != self.comp[j]) & ((self.side[i] != self.side[j]) | (self.side[i] < 0)) & ((i < j) | (self.comp[j] == self.largest))
            p, q, i, j = p[untold], q[untold], i[untold], j[untold]
            differ = np.bitwise_count(x[p] ^ y[q]).sum(axis=1, dtype=np.int64)
            keep = 9 * differ <= self.n[i] + self.n[j]
            i, j = i[keep], j[keep]
            # A pair is told by the first of its common bands alone.
            keep = ~(self.tags[i, : self.band] == self.tags[j, : self.band]).any(axis=1)
            yield self.node[i[keep]], self.node[j[keep]]
            at = end


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, number of the band, side, node, comp, n, sketch, tags) sorted by key: the pairs (a, b) to be tested."""
    for _, number, *columns in whole_keys(batches):
        for a, b in Block(int(number[0]), *columns).pairs():
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs whose shingle sets reach the threshold."""
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")  # few nodes are a small table, which is broadcast
    texts = docs.select(F.col(key).alias("node"), F.col(text).alias("text")).join(nodes, "node", "left_semi")
    sets = materialize(_shingle_sets(texts).dropDuplicates(["node"]), "shingle-sets")
    x, y = F.col("x"), F.col("y")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    # i / (x + y - i) >= 4 / 5
    links = materialize(both.where(9 * F.size(F.array_intersect(x, y)) >= 4 * (F.size(x) + F.size(y))).select("a", "b"), "links")
    discard(sets)
    discard(nodes)
    return links


def _simhash_pairs(reps: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b), a < b: pairs that span the classes of fingerprints which the SimHash operator finds among ``reps``."""
    texts = docs.select(F.col(key).alias("node"), F.col(text).alias("text")).join(reps.select("node"), "node", "left_semi").dropDuplicates(["node"])
    fps = materialize(simhash.with_fingerprints(texts, "node", "text"), "fingerprints")
    ones = materialize(fps.groupBy("fp").agg(F.min("id").alias("node")), "representatives")
    same = fps.join(ones, "fp").select(F.col("node").alias("a"), F.col("id").alias("b"))
    pairs = simhash.fingerprint_links(ones).unionByName(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    out = materialize(pairs.distinct(), "simhash-pairs")
    discard(fps)
    discard(ones)
    return out


def near_copies(docs: DataFrame, key: str, text: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, component) per key of ``docs``; the smallest key of the class, over links of Jaccard similarity 0.8 or more.

    Keys are integers that say nothing of the text (hashes), never null; rows
    that share a key are one document. Texts without words (null, empty,
    blank) are copies of each other. An empty table gives no rows.
    """
    signed = materialize(_signatures(docs, key, text), "signatures")
    reps = materialize(signed.groupBy("seq").agg(F.min("key").alias("node"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")]), "copies")
    banded = reps.select(F.explode("bands").alias("band"), "node")
    # The least row of each band stands for it: of all bands the same rows, as far as can be, so that pairs repeat.
    lead = banded.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("rows")).where("rows > 1")
    live = materialize(banded.join(lead, "band"), "band-rows")
    n = reps.select("node", "n")
    stars = live.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    sized = stars.join(n.withColumnsRenamed({"node": "a", "n": "x"}), "a").join(n.withColumnsRenamed({"node": "b", "n": "y"}), "b")
    stars = materialize(sized.where(5 * F.least("x", "y") >= 4 * F.greatest("x", "y")).select("a", "b"), "stars")
    # SimHash comes first: what its operator links is verified. A row in many bands then meets one lead, and others only where that has not joined them.
    near = _simhash_pairs(reps, docs, key, text)
    first = materialize(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(near).distinct(), "pairs")
    links = _verified(first, docs, key, text)
    parts = connected_components(links)
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    rest = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    rest = materialize(rest.join(first, ["a", "b"], "left_anti"), "pairs")
    tested = first.unionByName(rest)
    if not rest.isEmpty():
        links = materialize(links.unionByName(_verified(rest, docs, key, text)), "links")
        parts = connected_components(links)

    comp = live.join(parts, "node", "left").select("band", "rows", "node", F.coalesce("component", "node").alias("comp"))
    apart = comp.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
    blocks = F.ceil(F.col("rows") / block_rows).cast("int")
    # A band in blocks: each row goes to every pair of blocks with its own. Side -1: one block with itself.
    dealt = (
        comp.join(apart, "band", "left_semi")
        .withColumn("side", F.pmod("node", blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .join(reps.select("node", "n", "bands", "sketch"), "node")
        .select(
            F.xxhash64("band", F.least("side", "other"), F.greatest("side", "other")).alias("key"), (F.array_position("bands", F.col("band")) - 1).cast("int").alias("number"),
            F.when(F.col("side") == F.col("other"), -1).otherwise(F.col("side")).alias("side"), "node", "comp", "n", "sketch", "bands",
        )
    )
    dealt = dealt.mapInArrow(_tagged, "key long, number int, side int, node long, comp long, n long, sketch binary, tags binary")
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    pairs = materialize(dealt.mapInArrow(_block_pairs, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links = links.unionByName(_verified(pairs, docs, key, text))
        parts = connected_components(links)
    classes = reps.select("seq", "node").join(parts, "node", "left").select("seq", F.coalesce("component", "node").alias("component"))
    out = materialize(signed.select("key", "seq").distinct().join(classes, "seq").select("key", "component"), "classes")
    for table in (signed, reps, live, stars, first, rest, pairs, links, parts):
        discard(table)
    return out


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's bands cut to 32 bits each, packed."""
    for batch in batches:
        *columns, bands = batch.columns
        tags = bands.flatten().to_numpy().astype(np.uint32).reshape(-1, BANDS)
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in tags], pa.binary())], ["key", "number", "side", "node", "comp", "n", "sketch", "tags"])
