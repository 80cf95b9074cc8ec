"""A text encoder trained on the corpus: tf-idf, reduced by a block randomised singular value decomposition.

The corpus stays where it is. One pass over the texts finds the terms, one writes each text's
counts of them; every further pass multiplies those sparse rows with a narrow block and gives one small matrix per task:
the triangular factor of its share of the range (whose QR factors are put together in a tree), or its share of the
product back to the terms. Only matrices of terms x width leave the tasks, and the
vocabulary bounds those; no row of the corpus does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: Words whose features a task remembers at most, and features whose texts it counts before it gives them on.
WORDS, FEATURES = 1 << 18, 1 << 19
#: Terms of a vocabulary at most (the most frequent by documents), documents that a term needs, dimensions, columns of the block beyond those, rounds of powers, characters of a gram.
TERMS, MIN_DOCS, DIMS, BEYOND, POWERS, GRAMS = 16_384, 2, 64, 16, 2, 3
#: Groups of the tree that puts triangular factors together, and rows of a block of terms.
TREE, TERM_ROWS = 64, 1_024
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def features(text: str | None, grams: int) -> Iterator[str]:
    """The lower-case words of a text, cut at ASCII white space, and each word's runs of ``grams`` characters, its ends marked; none of a null."""
    for w in _SPACE.split((text or "").lower()):
        if w:
            yield w
            if grams:
                # A blank can't stand in a word, so no run is taken for one.
                marked = f" {w} "
                yield from (f" {marked[i : i + grams]}" for i in range(len(marked) - grams + 1))


@dataclass(frozen=True)
class TextEncoder:
    """``terms`` with their inverse document frequencies, and the basis (terms x dimensions) that texts are projected on."""

    terms: tuple[str, ...]
    idf: np.ndarray
    basis: np.ndarray
    grams: int = 0

    def encode(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """(row_index, e): the unit vector of each text; zero for one without a known term."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch, sparse in _sparse(batches, own.terms, own.idf, own.grams):
                yield _encoded(batch.column(0), sparse, own.basis)

        return rows.select("row_index", text).mapInArrow(run, "row_index long, e array<double>")

    def weights(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """(row_index, term, weight): the unit tf-idf row of each text, one row a term."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch, sparse in _sparse(batches, own.terms, own.idf, own.grams):
                for index, (at, w) in zip(batch.column(0), sparse, strict=True):
                    columns = [pa.array([index.as_py()] * len(at), pa.int64()), pa.array([own.terms[i] for i in at.tolist()], pa.string()), pa.array(w)]
                    yield pa.RecordBatch.from_arrays(columns, ["row_index", "term", "weight"])

        return rows.select("row_index", text).mapInArrow(run, "row_index long, term string, weight double")


class _Places:
    """The numbers of the features of texts. Words recur, so a task works out the features of each once; what it remembers is bounded by WORDS."""

    def __init__(self, grams: int, place: dict[str, int] | None = None):
        self.grams, self.given, self.place, self.words = grams, place is not None, place if place is not None else {}, {}
        #: The places of grams by their characters alone.
        self.cut = {t[1:]: i for t, i in self.place.items() if t.startswith(" ")}

    def _of(self, word: str) -> np.ndarray:
        if not word:
            return np.zeros(0, np.int64)
        marked = f" {word} "
        runs = [marked[i : i + self.grams] for i in range(len(marked) - self.grams + 1)] if self.grams else []
        if not self.given:
            self.place.setdefault(word, len(self.place))
            for run in runs:
                if run not in self.cut:
                    self.cut[run] = self.place.setdefault(" " + run, len(self.place))
        own = [self.place[word]] if word in self.place else []
        return np.array(own + [self.cut[run] for run in runs if run in self.cut], np.int64)

    def all(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The places of the features of each word, and how often the word occurs; a place may recur."""
        found, times, sizes = [], [], []
        for word, n in Counter(_SPACE.split((text or "").lower())).items():
            own = self.words.get(word)
            if own is None:
                if len(self.words) >= WORDS:
                    self.words.clear()
                own = self.words[word] = self._of(word)
            found.append(own)
            times.append(n)
            sizes.append(len(own))
        return np.concatenate(found), np.repeat(np.array(times), sizes)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The places of a text's features, ascending, and how often each occurs."""
        at, times = self.all(text)
        if not len(at):
            return at, times
        total = np.bincount(at, times)
        at = np.flatnonzero(total)
        return at, total[at].astype(np.int64)


def _weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = n * idf[at]
    return at, w / np.linalg.norm(w) if len(w) else w


def _encoded(index: pa.Array, sparse: list[tuple[np.ndarray, np.ndarray]], basis: np.ndarray) -> pa.RecordBatch:
    e = np.array([w @ basis[at] for at, w in sparse]).reshape(len(index), basis.shape[1])
    size = np.linalg.norm(e, axis=1, keepdims=True)
    e = np.divide(e, size, out=np.zeros_like(e), where=size > 0)
    return pa.RecordBatch.from_arrays([index, pa.array(list(e), pa.list_(pa.float64()))], ["row_index", "e"])


def _sparse(batches: Iterator[pa.RecordBatch], terms: tuple[str, ...], idf: np.ndarray, grams: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Each batch (row_index, text) with the places and unit weights of its texts' terms."""
    places = _Places(grams, {t: i for i, t in enumerate(terms)})
    for batch in batches:
        yield batch, [_weighted(*places.counts(text), idf) for text in batch.column(1).to_pylist()]


def _counted(rows: DataFrame, text: str, terms: tuple[str, ...], grams: int) -> DataFrame:
    """(row_index, at, n): the places of each text's terms and their counts, as a table, so that the passes of a fit read numbers and no texts."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(grams, {t: i for i, t in enumerate(shared.value)})
        for batch in batches:
            for a in range(0, len(batch), 1_024):
                found = [places.counts(t) for t in batch.column(1).slice(a, 1_024).to_pylist()]
                ends = pa.array(np.cumsum([0, *(len(at) for at, _ in found)]), pa.int32())
                columns = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c).astype(np.int32))) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1_024), *columns], ["row_index", "at", "n"])

    return scratch.written(rows.select("row_index", text).mapInArrow(run, "row_index long, at array<int>, n array<int>"), "counts")


def _rows(batch: pa.RecordBatch, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A batch (at, n) as places and unit weights."""
    ends = np.cumsum(batch.column(0).value_lengths().to_numpy())[:-1]
    return [_weighted(at, n, idf) for at, n in zip(*(np.split(c.flatten().to_numpy(), ends) for c in batch.columns), strict=True)] if len(batch) else []


def vocabulary(rows: DataFrame, text: str = "text", most: int = TERMS, min_docs: int = MIN_DOCS, grams: int = GRAMS) -> tuple[tuple[str, ...], np.ndarray]:
    """Terms by falling document frequency, then by name, and ln((1 + N) / (1 + df)) + 1 of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, df = _Places(grams), np.zeros(FEATURES, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, _ = places.all(text)
                if len(places.place) > len(df):
                    df = np.concatenate([df, np.zeros(len(places.place), np.int64)])
                df[at] += 1  # once for a place that recurs
                if len(places.place) >= FEATURES:
                    yield found(places, df)
                    places, df = _Places(grams), np.zeros(FEATURES, np.int64)
        yield found(places, df)

    def found(places: _Places, df: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(places.place), pa.string()), pa.array(df[: len(places.place)])], ["term", "df"])

    n = rows.count()
    df = rows.select(text).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    kept = df.where(F.col("df") >= min_docs).orderBy(F.desc("df"), "term").limit(most).collect()
    return tuple(r.term for r in kept), np.array([np.log((1 + n) / (1 + r.df)) + 1 for r in kept])


def _by_task(counted: DataFrame, model: tuple, share: Callable[[list[tuple[np.ndarray, np.ndarray]], tuple], np.ndarray | None], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], split: int | None) -> DataFrame:
    """(part, m): one matrix per task, the shares of its batches (at, n) merged; cut into blocks of ``split`` rows where asked."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = share(_rows(batch, shared.value[0]), shared.value)
            total = own if total is None else merge(total, own)
        if total is not None:
            blocks = [total] if split is None else [total[a : a + split] for a in range(0, len(total), split)]
            parts = np.random.default_rng().integers(0, TREE, 1) if split is None else np.arange(len(blocks))
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array([b.tobytes() for b in blocks], pa.binary())], ["part", "m"])

    return counted.select("at", "n").mapInArrow(run, "part long, m binary")


def _merged(parts: DataFrame, width: int, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """The matrices of each part merged, in the order of the parts: as many as the tree has groups, or the terms blocks."""

    def run(table: pa.Table) -> pa.Table:
        total = None
        for blob in table.column("m"):
            m = np.frombuffer(blob.as_buffer(), np.float64).reshape(-1, width)
            total = m if total is None else merge(total, m)
        return pa.table({"part": table.column("part").slice(0, 1), "m": pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())})

    found = parts.groupBy("part").applyInArrow(run, "part long, m binary").orderBy("part").collect()
    return [np.frombuffer(bytes(r.m), np.float64).reshape(-1, width) for r in found]


def _upper(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([a, b]), mode="r")


def _range_share(sparse, model) -> np.ndarray:
    block = model[1]
    return np.linalg.qr(np.array([w @ block[at] for at, w in sparse]).reshape(len(sparse), block.shape[1]), mode="r")


def _back_share(sparse, model) -> np.ndarray:
    """Of A^T A block R^-1: what a batch gives each term."""
    block = model[1]
    out = np.zeros_like(block)
    for at, w in sparse:
        out[at] += w[:, None] * (w @ block[at])
    return out


def fit(rows: DataFrame, text: str = "text", dims: int = DIMS, terms: int = TERMS, min_docs: int = MIN_DOCS, powers: int = POWERS, grams: int = GRAMS, seed: int = 0) -> TextEncoder:
    """The encoder of a corpus (row_index, text): the leading right singular vectors of its tf-idf matrix.

    Null and empty texts count as documents without terms. A corpus without
    terms gives an encoder of zero vectors; one with fewer terms than ``dims``
    gives as many dimensions as it has.
    """
    model, counted = _fitted(rows, text, dims, terms, min_docs, powers, grams, seed)
    if counted is not None:
        scratch.drop(counted)
    return model


def fit_encode(rows: DataFrame, text: str = "text", **options) -> tuple[TextEncoder, DataFrame]:
    """The encoder of a corpus, and the corpus by it, from the counts that the fit made: no text is cut up a third time."""
    settings = {"dims": DIMS, "terms": TERMS, "min_docs": MIN_DOCS, "powers": POWERS, "grams": GRAMS, "seed": 0, **options}
    model, counted = _fitted(rows, text, **settings)
    if counted is None:
        return model, model.encode(rows, text)
    shared = rows.sparkSession.sparkContext.broadcast((model.idf, model.basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = shared.value
        for batch in batches:
            yield _encoded(batch.column(0), _rows(batch.select(["at", "n"]), idf), basis)

    return model, counted.mapInArrow(run, "row_index long, e array<double>")


def _fitted(rows: DataFrame, text: str, dims: int, terms: int, min_docs: int, powers: int, grams: int, seed: int) -> tuple[TextEncoder, DataFrame | None]:
    vocab, idf = vocabulary(rows, text, terms, min_docs, grams)
    width = min(dims + BEYOND, len(vocab))
    if not width:
        return TextEncoder(vocab, idf, np.zeros((0, dims)), grams), None
    block = np.random.default_rng(seed).normal(size=(len(vocab), width))
    counted = _counted(rows, text, vocab, grams)
    for _ in range(powers + 1):
        # The range's triangular factor makes its columns orthonormal, so that rounding doesn't eat the lesser ones.
        width = block.shape[1]
        tops = _merged(_by_task(counted, (idf, block), _range_share, _upper, None), width, _upper)
        upper = np.linalg.qr(np.vstack(tops), mode="r")
        scale = np.abs(np.diag(upper)).max(initial=0.0)
        block = block @ np.linalg.pinv(upper, rcond=1e-12) if scale > 0 else block
        back = np.vstack(_merged(_by_task(counted, (idf, block), _back_share, np.add, TERM_ROWS), block.shape[1], np.add))
        # back = A^T Q for the orthonormal Q = A block; its left singular vectors span the terms' side.
        left, _, _ = np.linalg.svd(back, full_matrices=False)
        block = left
    basis = left[:, :dims]
    return TextEncoder(vocab, idf, basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1.0, 1.0), grams), counted
