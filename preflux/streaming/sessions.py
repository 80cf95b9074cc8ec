"""Rating sessions of many users as durable state: each rating appends a row to its user's factor, nothing is fitted anew.

The state of a user is a list with one entry per rated item: item, rating,
vector, and the item's row of the Cholesky factor. A new rating reads the list,
solves for one more row (quadratic in the user's ratings, where a fit is cubic) and
appends one entry. It lives in Spark's state store under the query's checkpoint,
so a restart, on other machines too, goes on where the checkpoint stands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, PreferenceConfig
from ..functions import vector as V
from ..operators import gp

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A user's session after a micro-batch: rated items in order, their ratings, vectors and weights, the factor's rows one after another.
SESSION = "user long, n long, lml double, rated array<long>, ratings array<double>, alpha array<double>, x binary, low binary"
#: Bytes of sessions that one pass over the catalogue takes along.
WAVE_BYTES = 64 << 20


class RatedItems:
    """A session in memory: vectors, ratings and factor of the items rated so far."""

    def __init__(self, config: PreferenceConfig, entries: list[tuple[int, float, bytes, bytes]] = ()):
        self.config = config
        self.ids = [e[0] for e in entries]
        self.ratings = [e[1] for e in entries]
        self.x = [np.frombuffer(bytes(e[2])) for e in entries]
        self.rows = [np.frombuffer(bytes(e[3])) for e in entries]

    def rate(self, item: int, rating: float, vector: np.ndarray) -> tuple[int, float, bytes, bytes] | None:
        """The entry to append; none for an item that is rated already."""
        if item in set(self.ids):
            return None
        c = self.config
        row = np.zeros(0)
        if self.ids:
            row = gp.lower_solve(self.low(), gp.kernel(np.stack(self.x), vector[None, :], c.length_scale, c.variance)[:, 0])
        # The noise keeps the exact value positive; rounding can eat it up.
        left = max(c.variance + c.noise**2 - float(row @ row), np.finfo(float).eps * c.variance)
        row = np.append(row, math.sqrt(left))
        self.ids.append(item)
        self.ratings.append(rating)
        self.x.append(vector)
        self.rows.append(row)
        return item, rating, vector.tobytes(), row.tobytes()

    def low(self) -> np.ndarray:
        low = np.zeros((len(self.rows), len(self.rows)))
        for i, row in enumerate(self.rows):
            low[i, : i + 1] = row
        return low

    def summary(self, user: int) -> dict:
        low, y = self.low(), np.array(self.ratings)
        half = gp.lower_solve(low, y)
        lml = -0.5 * float(half @ half) - float(np.log(np.diag(low)).sum()) - 0.5 * len(y) * math.log(2 * math.pi)
        blobs = {"x": np.concatenate(self.x).tobytes(), "low": np.concatenate(self.rows).tobytes()}
        return {"user": user, "n": len(y), "lml": lml, "rated": self.ids, "ratings": self.ratings, "alpha": gp.upper_solve(low, half), **blobs}


class _Rater(StatefulProcessor):
    def __init__(self, config: PreferenceConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "item long, rating double, x binary, row binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session = RatedItems(self.config, list(self.entries.get()))
        news = pd.concat(list(rows)).sort_values(["seq", "item"], kind="stable")
        added = [session.rate(int(i), float(r), np.asarray(e, float)) for i, r, e in zip(news["item"], news["rating"], news["e"], strict=True)]
        fresh = [entry for entry in added if entry]
        if fresh:
            self.entries.appendList(fresh)
            yield pd.DataFrame([session.summary(int(key[0]))])

    def close(self) -> None:
        pass


def follow_sessions(ratings: DataFrame, catalogue: DataFrame, config: PreferenceConfig = DEFAULT) -> DataFrame:
    """The stream of SESSION rows, one for each user whose session grew in a micro-batch.

    ``ratings`` is a stream (user, item, rating, seq), ``catalogue`` a table
    (row_index, e). The first rating of an item counts, in the order of seq; rows with a null and ratings of
    items that the catalogue lacks are left out. Hyperparameters are those of ``config``.
    """
    spark = ratings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    known = catalogue.select(F.col("row_index").alias("item"), F.col("e").cast("array<double>").alias("e"))
    rows = ratings.select(*[F.col(c).cast(t).alias(c) for c, t in (("user", "long"), ("item", "long"), ("rating", "double"), ("seq", "long"))]).dropna()
    return rows.join(known, "item").groupBy("user").transformWithStateInPandas(_Rater(config), outputStructType=SESSION, outputMode="Update", timeMode="None")


def next_items(catalogue: DataFrame, sessions: DataFrame, config: PreferenceConfig = DEFAULT) -> DataFrame:
    """(user, kind, row_index, score): for each of the SESSION rows the item with the highest mean (exploit) and that with the highest variance (explore).

    Rated items are left out, the lowest row_index wins a tie; a user who has rated everything gets no row.
    Sessions go along with the catalogue in waves of bounded size, and a task returns one candidate for each of them.
    """
    spark = catalogue.sparkSession
    size = sessions.agg(F.sum(F.octet_length("x") + F.octet_length("low"))).first()[0] or 0
    waves = max(1, -(-size // WAVE_BYTES))
    parts = [_wave_picks(catalogue, sessions.where(F.pmod(F.xxhash64("user"), F.lit(waves)) == w).collect(), config) for w in range(waves)]
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    first = F.min(F.struct((-F.col("score")).alias("cost"), "row_index")).alias("first")
    picks = best.groupBy("user", "kind").agg(first)
    return picks.select("user", "kind", "first.row_index", (-F.col("first.cost")).alias("score"))


def _wave_picks(catalogue: DataFrame, rows: list, config: PreferenceConfig) -> DataFrame:
    states = []
    for r in rows:
        low = np.zeros((r.n, r.n))
        low[np.tril_indices(r.n)] = np.frombuffer(bytes(r.low))
        x = np.frombuffer(bytes(r.x)).reshape(r.n, -1)
        state = gp.GPState(x, np.array(r.ratings), np.array(r.alpha), gp.lower_inverse(low), config.length_scale, config.variance, config.noise, r.lml)
        states.append((r.user, np.array(r.rated), state))
    shared = catalogue.sparkSession.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for batch in batches:
            if not len(batch):
                continue
            ids, q = batch.column(0).to_numpy(), V.batch_matrix(batch.column(1))
            for user, rated, state in shared.value:
                free = ~np.isin(ids, rated)
                if not free.any():
                    continue
                for kind, score in zip(("exploit", "explore"), gp.posterior(state, q[free]), strict=True):
                    top = np.lexsort((ids[free], -score))[0]
                    found = (float(-score[top]), int(ids[free][top]))
                    best[user, kind] = min(best.get((user, kind), found), found)
        users, kinds = zip(*best, strict=True) if best else ((), ())
        columns = [pa.array(users, pa.int64()), pa.array(kinds, pa.string()), pa.array([v[1] for v in best.values()], pa.int64()), pa.array([-v[0] for v in best.values()], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["user", "kind", "row_index", "score"])

    return catalogue.select("row_index", F.col("e").cast("array<double>").alias("e")).mapInArrow(run, "user long, kind string, row_index long, score double")


def run_to_end(spark: SparkSession, stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """All sessions that the stream's available input makes, the latest row of each user; the query ends there and can be started again from its checkpoint."""

    def take(batch: DataFrame, at: int) -> None:
        # A batch that is replayed overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{out}/batch={at}")

    stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(SESSION + ", batch long").parquet(out)
    return rows.groupBy("user").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("user", "batch")]), "batch").alias("row")).select("user", "row.*")
