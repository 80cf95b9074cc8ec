"""BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a batch are laid out as one linked list of symbols.
An index maps each mergeable pair to all its positions; a heap holds the ranks
that occur. Ranks are taken in ascending order, each is applied at all its
positions from left to right, and only the lists of the neighbouring pairs
change. Texts are then joined from their pre-tokens' ids.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

VOCABULARY = "word_bpe_49k.json"
#: Characters of text that are encoded together, and pre-tokens that a worker remembers; neither changes a result.
BATCH_CHARS, REMEMBERED = 2_000_000, 100_000
#: Fixed values of the vocabulary's format: Unicode white space, and the split pattern over it.
WHITE = "\t-\r \x85\xa0  -     　"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


class PairIndexBPE:
    """A vocabulary file's encoder; ``path`` is read where the object is made, and the tables travel with it."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.tokens = dict(zip(vocab.values(), vocab, strict=True))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.added.items()})
        letters = byte_symbols()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.merges: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            if max(made.get(left, -1), made.get(right, -1)) >= rank:
                raise ValueError("a merge comes before one that makes its parts")
            made[new] = rank
            self.merges.append((left, right, new))
        if any(max(made.get(a, -1), made.get(b, -1)) > r for r, (a, b, _) in enumerate(self.merges)):
            raise ValueError("ranks don't ascend along every chain of merges")
        self.rank = {a << 20 | b: r for r, (a, b, _) in reversed(list(enumerate(self.merges)))}
        self.keys = np.array(sorted(self.rank), np.int64)
        self.key_ranks = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.find = None

    def compile(self) -> None:
        self.find = regex.compile(PRETOKEN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.known: dict[str, tuple[bytes, str]] = {}
        self.recent: dict[str, tuple[bytes, str]] = {}

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens in order; an added token's string stands for itself, marked by a leading NUL."""
        out: list[str] = []
        for k, part in enumerate(self.split(text) if self.split else [text]):
            if k % 2:
                out.append("\0" + part)
            elif part:
                if not part.isascii():
                    # Character by character, as the format's lower-casing is: no final sigma.
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += self.find(part.lower())
        return out

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each distinct pre-token.

        A rank with many positions is applied to all of them at once in numpy;
        one with few, or whose two parts are equal (its positions can overlap),
        goes from left to right.
        """
        if not words:
            return []
        raw = [w.encode() for w in words]
        text = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        symbols = self.inner_ids[text]
        symbols[ends - 1] = self.last_ids[text[ends - 1]]
        n = len(symbols)
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[np.r_[0, ends[:-1]]] = -1
        first = np.flatnonzero(after >= 0)
        ranks = self.ranks_of(symbols[first], symbols[first + 1])
        first, ranks = first[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        cuts = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        places: dict[int, list[int]] = {int(ranks[order[a]]): first[order[a:b]].tolist() for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)}
        active = list(places)
        heapq.heapify(active)
        s, nx, pv = memoryview(symbols), memoryview(after), memoryview(before)
        rank, merges = self.rank, self.merges

        def note(q: int, i: int) -> None:
            if q in places:
                places[q].append(i)
            else:
                places[q] = [i]
                heapq.heappush(active, q)

        while active:
            r = heapq.heappop(active)
            left, right, new = merges[r]
            where = places.pop(r)
            if len(where) >= 24 and left != right:
                i = np.array(where)
                j = after[i]
                ok = (symbols[i] == left) & (j >= 0) & (symbols[j] == right)
                i, j = i[ok], j[ok]
                k = after[j]
                symbols[i], symbols[j], after[i] = new, -1, k
                more = k >= 0
                before[k[more]] = i[more]
                p = before[i]
                q = p >= 0
                at = np.concatenate([i[more], p[q]])
                found = self.ranks_of(symbols[at], symbols[after[at]])
                for x, y in zip(found.tolist(), at.tolist(), strict=True):
                    if x >= 0:
                        note(x, y)
                continue
            for i in sorted(where):
                j = nx[i]
                if s[i] != left or j < 0 or s[j] != right:
                    continue
                s[i], s[j] = new, -1
                k = nx[i] = nx[j]
                p = pv[i]
                if k >= 0:
                    pv[k] = i
                    if (q := rank.get(new << 20 | s[k])) is not None:
                        note(q, i)
                if p >= 0 and (q := rank.get(s[p] << 20 | new)) is not None:
                    note(q, p)
        alive = symbols >= 0
        counts = np.add.reduceat(alive, np.r_[0, ends[:-1]], dtype=np.int64)
        stop = np.cumsum(counts).tolist()
        ids = symbols[alive].tolist()
        return [ids[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it never merges."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], -1)

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids (little-endian unsigned 32-bit) and decoded text of each text."""
        if self.find is None:
            self.compile()
        lists = [self.pretokens(t) for t in texts]
        seen = set(chain.from_iterable(lists))
        table: dict[str, tuple[bytes, str]] = {}
        new: list[str] = []
        for w in seen:
            if (x := self.known.get(w) or self.recent.get(w)) is None:
                new.append(w)
            else:
                table[w] = x
        if len(self.known) < REMEMBERED:  # what comes back stays
            self.known.update((w, self.recent[w]) for w in seen & self.recent.keys())
        fresh: dict[str, tuple[bytes, str]] = {}
        for w in [w for w in new if w[0] == "\0" and w[1:] in self.added]:
            i = self.added[w[1:]]
            fresh[w] = (i.to_bytes(4, "little"), w[1:])
        plain = [w for w in new if w not in fresh]
        for w, ids in zip(plain, self.merge_words(plain), strict=True):
            fresh[w] = (array("I", ids).tobytes(), " ".join(map(self.tokens.__getitem__, ids)))
        table |= fresh
        if len(self.recent) > REMEMBERED // 2:
            self.recent = {}
        self.recent.update((w, x) for w, x in fresh.items() if len(w) <= 32)
        out = [[table[w] for w in ws] for ws in lists]
        return [b"".join([x for x, _ in o]) for o in out], [" ".join([y for _, y in o]) for o in out]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """(id_col, ids, n_tokens, decoded) per row: ids as array<int>, or ``packed`` as little-endian binary.

    A null or empty text has no ids and decodes to an empty text; a null id is
    passed through. The vocabulary file is read on the driver and broadcast
    (its size does not depend on the data), so executors need no copy of it.
    """
    bpe = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = "binary" if packed else "array<int>"
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.value
        for batch in batches:
            at = 0
            texts = batch.column(1)
            while at < len(texts):
                end, size, part = at, 0, []
                while end < len(texts) and (size < BATCH_CHARS):
                    part.append(texts[end].as_py() or "")
                    size += len(part[-1])
                    end += 1
                ids, decoded = coder.encode_batch(part)
                counts = [len(x) // 4 for x in ids]
                if packed:
                    column = pa.array(ids, pa.binary())
                else:
                    offsets = [0]
                    for n in counts:
                        offsets.append(offsets[-1] + n)
                    flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
                    column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), column, pa.array(counts, pa.int64()), pa.array(decoded, pa.string())], ["id", "ids", "n_tokens", "decoded"])
                at = end

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, ids {kind}, n_tokens long, decoded string")
    return out.withColumnRenamed("id", id_col)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_pair_index_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    out = encode(read(spark, sf_dir, "documents"), path or vocabulary_path(), packed=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
