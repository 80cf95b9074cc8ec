"""Nearest items to an item or to a phrase, by dot product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from .interfaces import Encoder


def find_row(poems: DataFrame, poem_id: str | None = None, title: str | None = None) -> int:
    """The first row with this id, or, where no id is given, with a title that holds ``title``, whatever the case; none is an error."""
    if poem_id is None and title is None:
        raise ValueError("an id or a title is needed")
    if poem_id is not None:
        hit, what = F.col("poem_id") == str(poem_id), f"id {poem_id}"
    else:
        hit, what = F.contains(F.lower("title"), F.lit(title.lower())), f"a title like {title!r}"
    row = poems.where(hit).agg(F.min("row_index")).first()[0]
    if row is None:
        raise ValueError(f"no poem has {what}")
    return row


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(row_index, similarity) of the k items most similar to ``query``; ties go to the lower row."""
    similarity = V.dot(F.col("e"), F.lit([float(x) for x in query]))
    return vectors.select("row_index", similarity.alias("similarity")).orderBy(F.desc("similarity"), "row_index").limit(k)


def nearest_to_row(vectors: DataFrame, row_index: int, k: int, exclude_self: bool = True) -> DataFrame:
    """The k items nearest to one; without it, unless ``exclude_self`` is false. A row without a vector is an error."""
    own = vectors.where(F.col("row_index") == row_index).select("e").first()
    if own is None:
        raise ValueError(f"row {row_index} has no vector")
    return nearest(vectors.where(F.col("row_index") != row_index) if exclude_self else vectors, own["e"], k)


def nearest_to_phrase(poems: DataFrame, vectors: DataFrame, phrase: str, encoder: Encoder, k: int, poet: str | None = None) -> DataFrame:
    """The k items nearest to a phrase, among those whose author's name holds ``poet``; an error if none is left."""
    if poet is not None:
        left = poems.where(F.contains(F.lower("poet"), F.lit(poet.lower()))).select("row_index")
        if left.isEmpty():
            raise ValueError(f"no poem is left with an author like {poet!r}")
        vectors = vectors.join(left, "row_index", "left_semi")
    asked = poems.sparkSession.createDataFrame([(0, phrase)], "row_index long, text string")
    return nearest(vectors, encoder.encode(asked, "text").first()["e"], k)
