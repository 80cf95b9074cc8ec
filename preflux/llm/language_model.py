"""Language-model scores by a weighted backoff automaton.

The model has Dirichlet-smoothed bigrams over add-one unigrams:
p(w | h) = (c(hw) + K p(w)) / (c(h) + K). As an automaton, every seen word (and
the start of a text) is a state; a seen bigram is an arc of its state; any
other word takes the state's failure arc, of weight K / (c(h) + K), to the root
state and an arc from there. One pass from left to right carries the state and
adds up log-probabilities.

No table of the whole corpus is held anywhere: a chunk of texts sends the
buckets its distinct words and bigrams with their training counts, gets the
corpus counts of just these back, and builds its part of the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import BUCKET_HASHES, bucket_cuts, chunk_count, mix, pack, text_bytes, unpack
from .common import read

#: Weight of the unigrams in a state's distribution, in counts.
PRIOR = 4.0
HELD_OUT = 2
#: Hash bits of a bigram beyond those that number the corpus's tokens: a false match once in 2**SPARE_BITS.
SPARE_BITS = 20
BYTES_PER_WORD = 6
_END, _START = 0x5EED0E4D, 0x5EED57A7


class Tokens:
    """Texts as flat token numbers; distinct tokens have content hashes, and each text ends with one end token."""

    def __init__(self, texts: list[str]):
        known: dict[bytes | None, int] = {None: 0}
        flat: list[int] = []
        lengths = []
        for t in texts:
            ws = t.encode().lower().split()
            for w in ws:
                flat.append(known.setdefault(w, len(known)))
            flat.append(0)
            lengths.append(len(ws) + 1)
        digest = xxhash.xxh64_intdigest
        self.hashes = np.array([_END, *(digest(w, 3) for w in known if w is not None)], np.uint64)
        self.ids = np.array(flat, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths

    def bigrams(self, bits: int) -> np.ndarray:
        """The hash of each token with the one before it (the start of its text for the first)."""
        before = np.empty(len(self.ids), np.uint64)
        before[1:] = self.hashes[self.ids[:-1]]
        before[self.first] = _START
        return mix(before * np.uint64(0xD6E8FEB86659FD93) + self.hashes[self.ids]) >> np.uint64(64 - bits)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, after a byte that says how many."""
    top = int(counts.max()) if len(counts) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _distinct(hashes: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct hashes, the place of each hash among them, and how many were trained on."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    return distinct, inverse, np.bincount(inverse[trained], minlength=len(distinct))


def _lists(tokens: Tokens, held: np.ndarray, bits: int):
    trained = np.repeat(~held, tokens.lengths)
    words = _distinct(tokens.hashes[tokens.ids], trained)
    pairs = _distinct(tokens.bigrams(bits), trained)
    return words, pairs


def _send(word_buckets: int, pair_buckets: int, bits: int):
    def run(key, table):
        tokens = Tokens([t or "" for t in table.column("text").to_pylist()])
        words, pairs = _lists(tokens, np.array(table.column("held").to_pylist(), bool), bits)
        out: dict[str, list] = {"bucket": [], "blob": [], "counts": []}
        for (distinct, _, counts), buckets, width, at in ((words, word_buckets, 64, 0), (pairs, pair_buckets, bits, word_buckets)):
            cuts = bucket_cuts(distinct, buckets, width)
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                out["bucket"].append(at + b)
                out["blob"].append(pack(distinct[cuts[b] : cuts[b + 1]]))
                out["counts"].append(_narrow(counts[cuts[b] : cuts[b + 1]]))
        n = len(out["bucket"])
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "chunk": pa.array([key[0].as_py()] * n, pa.int64()), "blob": pa.array(out["blob"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return run


def _total(table):
    """The corpus counts of each list's hashes."""
    lists = [unpack(b) for b in table.column("blob").to_pylist()]
    counts = np.concatenate([_wide(b) for b in table.column("counts").to_pylist()])
    _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(inverse, weights=counts).astype(np.int64)[inverse]
    parts = np.split(total, np.cumsum([len(x) for x in lists])[:-1])
    return table.select(["chunk", "bucket"]).append_column("counts", pa.array([_narrow(p) for p in parts], pa.binary()))


class BackoffAutomaton:
    """States: the root and the words of a chunk that were trained on (and the start); arcs: its bigrams."""

    def __init__(self, word_counts: np.ndarray, pair_counts: np.ndarray, trained_texts: int, n: int, v: int):
        self.root = (word_counts + 1) / (n + v + 1)
        self.pairs = pair_counts
        self.visits = np.append(word_counts, trained_texts).astype(float)
        self.fail = np.log10(PRIOR / (self.visits + PRIOR))

    def traverse(self, words: np.ndarray, arcs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of each token's probability in the state that the tokens before it lead to."""
        state = np.empty(len(words), np.int64)
        state[1:] = words[:-1]
        state[first] = len(self.root)  # a text begins in the start's state
        p = self.root[words]
        seen = self.pairs[arcs] > 0
        by_arc = np.log10((self.pairs[arcs] + PRIOR * p) / (self.visits[state] + PRIOR))
        # A state that was never trained on is the root: its failure arc weighs nothing.
        return np.where(seen, by_arc, self.fail[state] + np.log10(p))


def _score(word_buckets: int, pair_buckets: int, bits: int, n: int, v: int, trained_texts: int, id_type: pa.DataType):
    def run(left, right):
        tokens = Tokens([t or "" for t in left.column("text").to_pylist()])
        held = np.array(left.column("held").to_pylist(), bool)
        words, pairs = _lists(tokens, held, bits)
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True))
        counts = []
        for (distinct, _, _), buckets, width, at in ((words, word_buckets, 64, 0), (pairs, pair_buckets, bits, word_buckets)):
            total = np.zeros(len(distinct), np.int64)
            cuts = bucket_cuts(distinct, buckets, width)
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                total[cuts[b] : cuts[b + 1]] = _wide(answers[at + b])
            counts.append(total)
        model = BackoffAutomaton(counts[0], counts[1], trained_texts, n, v)
        word = words[1]
        known = counts[0][word]
        base = np.log10((known + 1) / (n + v + 1))
        score = model.traverse(word, pairs[1], tokens.first)

        def per_text(x: np.ndarray) -> np.ndarray:
            # Summed text by text, in pairs: the error of a long text's sum stays small.
            return np.array([x[a : a + n].sum() for a, n in zip(tokens.first, tokens.lengths, strict=True)])

        return pa.table(
            {
                "id": left.column("id").cast(id_type), "held_out": left.column("held"), "n_tokens": pa.array(tokens.lengths), "n_known": pa.array(per_text((known > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(held), n, np.int64)), "base_score": pa.array(per_text(base)), "score": pa.array(per_text(score)),
            }
        )

    return run


def _vocabulary_lists(buckets: int):
    """Distinct training words of each batch, by bucket, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = Tokens([t or "" for t in batch.column(0).to_pylist()])
            counts = np.bincount(tokens.ids, minlength=len(tokens.hashes))
            order = np.argsort(tokens.hashes)
            distinct, counts = tokens.hashes[order], counts[order]
            cuts = bucket_cuts(distinct, buckets)
            full = np.flatnonzero(np.diff(cuts)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), pa.array([pack(distinct[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()), pa.array([_narrow(counts[cuts[b] : cuts[b + 1]]) for b in full], pa.binary())],
                ["bucket", "blob", "counts"],
            )

    return run


def _vocabulary_size(table):
    every = np.concatenate([unpack(b) for b in table.column("blob").to_pylist()])
    n = sum(int(_wide(b).sum()) for b in table.column("counts").to_pylist())
    return pa.table({"n": pa.array([n], pa.int64()), "v": pa.array([len(np.unique(every))], pa.int64())})


def score_texts(docs: DataFrame, held: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    ``held`` is a boolean SQL expression: rows where it holds are scored but
    not learned from (null counts as false). A null or empty text is its end
    token alone. With nothing to learn from, every token has probability one
    under the base and the model. Repeated rows count as often as they occur;
    null ids are passed through; no rows give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    size = text_bytes(docs, text_col)
    words = max(1, size // BYTES_PER_WORD)
    chunks, word_buckets, pair_buckets = chunk_count(size), max(1, words // BUCKET_HASHES // 4), max(1, words // BUCKET_HASHES)
    bits = min(64, words.bit_length() + SPARE_BITS)
    id_type = docs.schema[id_col].dataType
    rows = docs.select(
        F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).alias("chunk"), F.col(id_col).alias("id"), F.coalesce(F.expr(held), F.lit(False)).alias("held"), F.col(text_col).alias("text")
    )
    learned = rows.where("not held").select("text")
    sizes = learned.mapInArrow(_vocabulary_lists(word_buckets), "bucket long, blob binary, counts binary").groupBy("bucket").applyInArrow(_vocabulary_size, "n long, v long")
    n, v = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    trained_texts = learned.count()
    lists = rows.groupBy("chunk").applyInArrow(_send(word_buckets, pair_buckets, bits), "bucket long, chunk long, blob binary, counts binary")
    answers = lists.groupBy("bucket").applyInArrow(_total, "chunk long, bucket long, counts binary")
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(word_buckets, pair_buckets, bits, n, v, trained_texts, to_arrow_type(id_type)),
        f"id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return out.withColumnRenamed("id", id_col)


def op2_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those whose crc32 of the id leaves another remainder than 2."""
    return score_texts(read(spark, sf_dir, "documents"), f"crc32(cast(doc_id as string)) % 7 = {HELD_OUT}")
