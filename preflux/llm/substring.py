"""Substring dedup: Rabin-Karp hashes of every window of 35 words, counted in Spark.

Each chunk of texts hashes all its windows, sends the distinct hashes to the
buckets of the hash space, and learns which of them other chunks hold too. The
windows that look repeated are then counted once more, with a second hash of
other word digests beside the first, so that 128 bits agree before a word goes. Repeated windows
merge into maximal removal intervals. At 10**13 windows a false repeat is expected once in millions of runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import BUCKET_HASHES, bucket_cuts, chunk_count, pack, prefix, rolling, text_bytes, unpack
from .common import read

WINDOW = 35
#: Seeds of the word digests of either hash.
FIRST, SECOND = 7, 11
#: Bytes of text that a window starts at on average; only sizes the buckets.
BYTES_PER_WORD = 6


class Windows:
    """The windows of a chunk's texts: their flat starts over all words, and hashes from digests of the distinct words."""

    def __init__(self, texts: list[str], window: int):
        self.lists = [t.encode().split() for t in texts]
        self.window = window
        known: dict[bytes, int] = {}
        for ws in self.lists:
            for w in set(ws).difference(known):
                known[w] = len(known)
        flat: list[int] = []
        for ws in self.lists:
            flat += map(known.__getitem__, ws)
        self.words, self.ids = list(known), np.array(flat, np.int64)
        lengths = np.fromiter(map(len, self.lists), np.int64, len(self.lists))
        self.ends = np.cumsum(lengths)
        doc = np.repeat(np.arange(len(self.lists)), lengths)
        self.starts = np.flatnonzero(doc[: -window + 1] == doc[window - 1 :]) if len(flat) >= window else np.zeros(0, np.int64)

    def hashes(self, seed: int, some: np.ndarray | None = None) -> np.ndarray:
        """Of all windows, or of those that are marked."""
        digest = xxhash.xxh64_intdigest
        values = np.array([digest(w, seed) for w in self.words], np.uint64)[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        starts = self.starts if some is None else self.starts[some]
        return rolling(prefix(values), starts, starts + self.window)


def _send(buckets: int, window: int):
    def run(key, table):
        distinct = np.unique(Windows([t or "" for t in table.column("text").to_pylist()], window).hashes(FIRST))
        cuts = bucket_cuts(distinct, buckets)
        full = np.flatnonzero(np.diff(cuts))
        blobs = [pack(distinct[cuts[b] : cuts[b + 1]]) for b in full]
        return pa.table({"bucket": pa.array(full, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(full), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _count(table):
    """A bit for each hash of each list: another chunk has it."""
    return _shared(table, [unpack(b) for b in table.column("blob").to_pylist()])


def _count_doubles(table):
    """The same for pairs of hashes."""
    return _shared(table, [np.frombuffer(b, [("a", np.uint64), ("b", np.uint64)]) for b in table.column("blob").to_pylist()])


def _shared(table, lists: list[np.ndarray]):
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = np.zeros(len(every) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(every), bool)
    shared[order] = same[1:] | same[:-1]
    parts = np.split(shared, np.cumsum([len(x) for x in lists])[:-1])
    keep = [i for i, p in enumerate(parts) if p.any()]
    picked = table.select(["chunk", "bucket"]).take(pa.array(keep, pa.int64()))
    return picked.append_column("bits", pa.array([np.packbits(parts[i]).tobytes() for i in keep], pa.binary()))


def _doubles(windows: Windows, buckets: int, answers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which windows look repeated, in the chunk itself or by the buckets' answers; of these the distinct pairs of both hashes in order, which of them each has, and how often each occurs."""
    hashes = windows.hashes(FIRST)
    distinct, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    repeated = counts > 1
    cuts = bucket_cuts(distinct, buckets)
    for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        n = cuts[b + 1] - cuts[b]
        repeated[cuts[b] : cuts[b + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    looks = repeated[inverse]
    pairs = np.empty(int(looks.sum()), [("a", np.uint64), ("b", np.uint64)])
    pairs["a"], pairs["b"] = hashes[looks], windows.hashes(SECOND, looks)
    order = np.lexsort((pairs["b"], pairs["a"]))
    ranked = pairs[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(ranked), np.int64)
    place[order] = np.cumsum(new) - 1
    return looks, ranked[new], place, np.bincount(place, minlength=int(new.sum()))


def _send_doubles(buckets: int, window: int):
    def run(left, right):
        _, pairs, _, _ = _doubles(Windows([t or "" for t in left.column("text").to_pylist()], window), buckets, right)
        cuts = bucket_cuts(pairs["a"].copy(), buckets)
        full = np.flatnonzero(np.diff(cuts))
        key = left.column("chunk")[0].as_py() if len(left) else 0
        blobs = [pairs[cuts[b] : cuts[b + 1]].tobytes() for b in full]
        return pa.table({"bucket": pa.array(full, pa.int64()), "chunk": pa.array([key] * len(full), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _remove(buckets: int, window: int, id_type: pa.DataType):
    def run(left, right):
        windows = Windows([t or "" for t in left.column("text").to_pylist()], window)
        first, second = (right.filter(pa.compute.equal(right.column("round"), r)) for r in (1, 2))
        looks, pairs, inverse, counts = _doubles(windows, buckets, first)
        repeated = counts > 1
        cuts = bucket_cuts(pairs["a"].copy(), buckets)
        for b, bits in zip(second.column("bucket").to_pylist(), second.column("bits").to_pylist(), strict=True):
            repeated[cuts[b] : cuts[b + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[b + 1] - cuts[b]).astype(bool)
        ends = windows.ends
        edge = np.zeros((ends[-1] if len(ends) else 0) + 1, np.int64)
        hit = windows.starts[looks][repeated[inverse]]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        out: dict[str, list] = {"n_words": [], "n_removed": [], "spans": [], "kept": []}
        for ws, end in zip(windows.lists, ends, strict=True):
            mask = gone[end - len(ws) : end]
            at = np.flatnonzero(np.diff(np.r_[False, mask, False]))
            out["n_words"].append(len(ws))
            out["n_removed"].append(int(mask.sum()))
            out["spans"].append([{"start": int(a), "end": int(b)} for a, b in at.reshape(-1, 2)])
            out["kept"].append(b" ".join([w for w, g in zip(ws, mask.tolist(), strict=True) if not g] if len(at) else ws).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": left.column("id").cast(id_type), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "spans": pa.array(out["spans"], span), "kept": pa.array(out["kept"], pa.string())})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words, n_removed, spans, kept) per row; spans are word intervals, end exclusive.

    A null text has no words and keeps an empty text, a text shorter than the
    window keeps all. Repeated rows are repeats of each other and lose their
    windows; null ids are passed through. No rows give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    size = text_bytes(docs, text_col)
    chunks, buckets = chunk_count(size), max(1, size // BYTES_PER_WORD // BUCKET_HASHES)
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).alias("chunk"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = rows.groupBy("chunk").applyInArrow(_send(buckets, window), "bucket long, chunk long, blob binary")
    answers = lists.groupBy("bucket").applyInArrow(_count, "chunk long, bucket long, bits binary")
    doubles = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_send_doubles(buckets, window), "bucket long, chunk long, blob binary")
    verified = doubles.groupBy("bucket").applyInArrow(_count_doubles, "chunk long, bucket long, bits binary")
    told = answers.withColumn("round", F.lit(1)).unionByName(verified.withColumn("round", F.lit(2)))
    out = rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        _remove(buckets, window, to_arrow_type(id_type)),
        f"id {id_type.simpleString()}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string",
    )
    return out.withColumnRenamed("id", id_col)


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows."""
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
