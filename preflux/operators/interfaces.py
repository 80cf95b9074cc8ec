"""What can be plugged in: an encoder of texts and a reducer of vectors."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

from . import visual


class Encoder(Protocol):
    def encode(self, rows: DataFrame, text: str) -> DataFrame:
        """(row_index, e) with unit vectors, for rows that have row_index and the text column."""


class Reducer(Protocol):
    def fit(self, vectors: DataFrame) -> Reducer: ...

    def transform(self, vectors: DataFrame) -> DataFrame:
        """(row_index, x, y) for (row_index, e)."""


class HashingEncoder:
    """Signed n-gram hashes: a stand-in for a trained encoder, not its equal."""

    def __init__(self, dim: int = 64, n: int = 3):
        self.dim, self.n = dim, n

    def encode(self, rows: DataFrame, text: str) -> DataFrame:
        return visual.embed_hashing(rows, text, self.dim, self.n)


class PCAReducer:
    """Two principal components: a stand-in for a neighbour embedding. Its state is a mean and a small matrix."""

    mean: np.ndarray
    components: np.ndarray

    def fit(self, vectors: DataFrame) -> PCAReducer:
        self.mean, self.components = visual.fit_pca(vectors, 2)
        return self

    def transform(self, vectors: DataFrame) -> DataFrame:
        return visual.project(vectors, self.mean, self.components)
