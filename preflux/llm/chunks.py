"""Texts in bounded chunks, and sorted hash lists that chunks send to buckets and get answers on.

A chunk holds a few megabytes of texts. It sends each bucket of the hash space
one packed list of distinct hashes; the bucket compares the lists of all chunks
and answers each with one bit per hash. A shuffle so moves about six bytes per
distinct hash and chunk one way and a bit back, and the plan stays lazy: the
texts' own exchange is used again wherever a chunk is needed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text of a chunk, and hashes of a bucket, on average.
CHUNK_BYTES, BUCKET_HASHES = 4 << 20, 2 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def chunk_count(size: int) -> int:
    return max(1, -(-size // CHUNK_BYTES))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of FACTOR and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((FACTOR, INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``rolling`` takes the polynomial hash of any window."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[1] if len(values) else values, dtype=np.uint64, out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for each pair, the same wherever the values stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[0][start] + (end - start).astype(np.uint64))


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Differences of an ascending list, in as few bytes each as the largest needs."""
    d = np.diff(sorted_hashes)
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    body = np.ascontiguousarray(d).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return bytes([width]) + sorted_hashes[:1].tobytes() + body


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    d = np.zeros((len(body) + 1, 8), np.uint8)
    d[0] = np.frombuffer(blob, np.uint8, 8, 1)
    d[1:, :width] = body
    return np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64)


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Ends of each bucket's share of an ascending list; buckets are equal ranges of hashes of so many bits."""
    bounds = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(sorted_hashes, bounds, "left"), len(sorted_hashes)]
