"""Ratings that arrive as a stream: each micro-batch adds first ratings and, by choice, re-fits the model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import learner


def follow_ratings(stream: DataFrame, session: learner.Session, checkpoint: str, refit: Callable[[learner.Session], None] | None = None, key: str = "row_index", rating: str = "rating", order: str = "seq") -> StreamingQuery:
    """Start a query that keeps ``session`` up to date; a rating of an item that is rated already is ignored.

    A batch that is replayed after a failure changes nothing, so the sink is
    idempotent. A session holds one person's ratings, which are few.
    """

    def take(batch: DataFrame, _: int) -> None:
        first = batch.where(F.col(key).isNotNull() & F.col(rating).isNotNull()).groupBy(key).agg(F.min(F.struct(order, rating)).alias("first"))
        rows = first.select(key, f"first.{rating}", f"first.{order}").orderBy(order).toLocalIterator()
        added = [session.rate(r[key], float(r[rating])) for r in rows]
        if any(added) and refit:
            refit(session)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
