"""Hard negatives by distributed radix selection of integer scores.

Scores are integer inner products of anchors with all rows, computed block by
block in exact arithmetic and never stored. What is wanted of each window of an
anchor's scores, its first k rows, is found without sorting: a pass counts the
scores of each window by their highest digit, Spark adds the histograms up, and
the digit in which the kth row falls becomes the next window; so digit by digit,
and among equal scores on by the digits of the id. As soon as no more than
``SPARE`` rows stand in the last bucket, a pass gathers the rows in and above it.

Anchors are taken in waves of bounded size, which alone are broadcast. However
many rows share a score or a vector, a window keeps 256 counts of a digit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, read, scratch_root

#: Scale of the components, and the query's relabelling, anchors, positives, negatives and bounds in percent.
SCALE, RELABEL, LABELS, ANCHORS, POSITIVES, NEGATIVES, LOW, HIGH = 256, 7, 10, 50, 5, 3, 50, 95
#: Bytes of the anchors of a wave on average, rows that a last bucket may hold when it is gathered, bits of a digit, and cells of a block of scores.
WAVE_BYTES, SPARE, DIGIT, CELLS = 4 << 20, 32, 8, 1 << 21
#: Up to this size sums of products are exact in double precision.
EXACT = float(1 << 53)


def usable_rows(embeddings: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, v) of the rows that take part: no null id, label, vector or component, none that isn't finite.

    An id names one row: of rows that repeat it, the one with the smallest
    label, then vector, stays.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    one = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.struct(F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))).alias("row"))
    return one.select("id", "row.label", "row.v")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The floor of SCALE * x for a list column, shorter vectors filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; an error where one doesn't fit into 64 bits."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = whole(q) @ whole(x).T
    if max(map(abs, out.ravel())) >= 1 << 63:
        raise OverflowError("a score doesn't fit into 64 bits")
    return out.astype(np.int64)


class Wave:
    """Anchors (ids, labels, vectors) and the windows that are selected from: rows (anchor's place, low, high) of scores, and whether they take rows of the anchor's label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q

    def windows(self, same: bool, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict:
        """``top``/``bottom``: bounds of the scores still open; ``first``/``last``: bounds of the ids, open once both score bounds are equal."""
        order, edge, n = np.argsort(place, kind="stable"), np.iinfo(np.int64), len(place)
        return {"same": same, "place": place[order], "high": high[order], "bottom": low[order], "top": high[order], "first": np.full(n, edge.min), "last": np.full(n, edge.max), "order": order}

    def cells(self, batches: Iterator[pa.RecordBatch], w: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, scores, ids) of each batch's rows of the right label in a window, that are not the anchor itself."""
        starts = np.searchsorted(w["place"], np.arange(len(self.ids) + 1))
        active = np.flatnonzero(np.diff(starts))
        for batch in batches:
            ids, labels, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), self.q.shape[1])
            step = max(1, CELLS // max(1, len(batch)))
            for at in range(0, len(active), step):
                places = active[at : at + step]
                for place, scores in zip(places.tolist(), _scores(self.q[places], x), strict=True):
                    mine = slice(starts[place], starts[place + 1])
                    near = (scores >= w["bottom"][mine].min()) & (scores <= w["high"][mine].max()) & ((labels == self.labels[place]) == w["same"])
                    if w["same"]:
                        near &= ids != self.ids[place]
                    if near.any():
                        scores, those = scores[near], ids[near]
                        for k in range(mine.start, mine.stop):
                            yield k, scores, those


def _shifts(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits below the highest digit of the numbers from 0 to high - low."""
    return np.array([max(0, (h - x).bit_length() - DIGIT) for x, h in zip(low.tolist(), high.tolist(), strict=True)], np.int64)


def _digits(w: dict, k: int, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The current digit of the rows in window k's open bucket: of the score from the top, or of the id once all scores in it are equal."""
    shift = w["shift"][k]
    inside = (scores >= w["bottom"][k]) & (scores <= w["top"][k])
    if w["bottom"][k] < w["top"][k]:
        return (w["top"][k] - scores[inside]).view(np.uint64) >> np.uint64(shift)
    those = ids[inside]
    those = those[(those >= w["first"][k]) & (those <= w["last"][k])]
    return (those.view(np.uint64) - np.uint64(int(w["first"][k]) & (1 << 64) - 1)) >> np.uint64(shift)


def _bars(rows: DataFrame, wave: Wave, w: dict, k: int) -> dict[int, list[tuple[int, int]]]:
    """(digit, count) of each open window, from the best digit until k rows are reached: counted by task, added up by Spark, k bars a window at most."""
    shared = rows.sparkSession.sparkContext.broadcast((wave, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = shared.value
        counts: dict[int, np.ndarray] = {}
        for i, scores, ids in own.cells(batches, now):
            if now["open"][i]:
                digits = _digits(now, i, scores, ids)
                if len(digits):
                    counts[i] = counts.get(i, 0) + np.bincount(digits.astype(np.int64), minlength=1 << DIGIT)
        for i, c in counts.items():
            d = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i, np.int64)), pa.array(d), pa.array(c[d])], ["window", "digit", "n"])

    sums = rows.mapInArrow(run, "window long, digit long, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy("window").orderBy("digit")) - F.col("n")
    bars: dict[int, list[tuple[int, int]]] = {}
    for i, digit, n in sums.withColumn("above", above).where(F.col("above") < k).orderBy("window", "digit").select("window", "digit", "n").collect():
        bars.setdefault(i, []).append((digit, n))
    shared.destroy()
    return bars


def select_first(rows: DataFrame, wave: Wave, w: dict, k: int) -> DataFrame:
    """(window, score, id, rank) of the first k rows of each window, higher scores first, smaller ids among equals."""
    need, w["open"] = np.full(len(w["place"]), k), w["bottom"] <= w["top"]
    while w["open"].any():
        w["shift"] = np.where(w["bottom"] < w["top"], _shifts(w["bottom"], w["top"]), _shifts(w["first"], w["last"]))
        bars = _bars(rows, wave, w, k)
        for i in np.flatnonzero(w["open"]).tolist():
            above = 0
            for digit, count in bars.get(i, ()):
                if above + count >= need[i]:
                    break
                above += count
            else:  # fewer rows than wanted: all of them
                w["open"][i] = False
                continue
            low, high = digit << int(w["shift"][i]), (digit + 1 << int(w["shift"][i])) - 1
            need[i] -= above
            w["open"][i] = count > need[i] + SPARE
            if w["bottom"][i] < w["top"][i]:
                top = int(w["top"][i])
                w["bottom"][i], w["top"][i] = max(int(w["bottom"][i]), top - high), top - low
            else:
                first = int(w["first"][i])
                w["first"][i], w["last"][i] = first + low, min(int(w["last"][i]), first + high)
    shared = rows.sparkSession.sparkContext.broadcast((wave, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = shared.value
        for i, scores, ids in own.cells(batches, now):
            low, one = now["bottom"][i], now["bottom"][i] == now["top"][i]
            take = (scores <= now["high"][i]) & ((scores > low) | (scores == low) & (ids <= now["last"][i]) if one else scores >= low)
            if take.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(take.sum()), now["order"][i], np.int64)), pa.array(scores[take]), pa.array(ids[take])], ["window", "score", "id"])

    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "id"))
    return rows.mapInArrow(run, "window long, score long, id long").withColumn("rank", rank).where(F.col("rank") <= k)


def _waves(rows: DataFrame, is_anchor: Column, width: int) -> Iterator[Wave]:
    """The anchors, dealt by a hash of their ids to waves of WAVE_BYTES on average."""
    anchors = rows.where(is_anchor)
    n = -(-anchors.count() * max(1, width) * 8 // WAVE_BYTES)
    for at in range(n):
        table = anchors.where(F.pmod(F.xxhash64("id"), F.lit(n)) == at).toArrow().combine_chunks()
        for batch in table.to_batches():
            yield Wave(batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first ``positives`` other rows of
    the same label, the first ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive.

    ``rows`` is (id, label, v) as ``usable_rows`` makes it, from a table that can be read again and again; ids are distinct. Higher scores
    come first, smaller ids among equals. Anchors without another row of their label, and windows without a row, give nothing; so do empty tables.
    Shorter vectors count as filled up with zeros. A score beyond 64 bits is an error.
    """
    spark = rows.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double")))
    width, longest = rows.agg(F.max(F.size("v")), F.max(norm)).first()
    kind = "window long, anchor_id long, positive_id long, positive_score long"
    path = f"{scratch_root(spark)}/hard-negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for wave in _waves(rows, is_anchor, width or 0):
        reach = np.sqrt((wave.q * wave.q).sum(1)) * longest + 1
        far = np.array([min(int(x), (1 << 63) - 1) if x < EXACT * EXACT else (1 << 63) - 1 for x in reach.tolist()], np.int64)
        best = select_first(rows, wave, wave.windows(True, np.arange(len(far)), -far, far), positives).select("window", "id", "score").toArrow()
        place, ids, score = (best.column(i).to_numpy() for i in range(3))
        scores = score.tolist()
        least, most = (np.array([f(p) for p in scores], np.int64) for f in (lambda p: -(-low * p // 100), lambda p: high * p // 100))
        asked = spark.createDataFrame(zip(range(len(scores)), wave.ids[place].tolist(), ids.tolist(), scores), kind)
        found = select_first(rows, wave, wave.windows(False, place, least, most), negatives)
        # As many windows as a wave's anchors have positives: a bounded table.
        out = found.join(F.broadcast(asked), "window").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op13_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector against all vectors."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % RELABEL == 0, (label + 1) % LABELS).otherwise(label)
    rows = materialize(usable_rows(read(spark, sf_dir, "embeddings").withColumn("label", moved)), "usable")
    out = hard_negatives(rows, F.col("id") % ANCHORS == 0)
    discard(rows)
    return out


OP13_SQL = f"""
WITH vecs AS (SELECT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id AS id, b.label AS bl, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM vecs a, vecs b WHERE a.vec_id % {ANCHORS} = 0),
positives AS (SELECT anchor_id, al, id AS positive_id, s AS p FROM scores WHERE al = bl AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, id) AS INT) AS rank, id AS negative_id, p AS positive_score, s AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE bl <> positives.al AND {LOW} * p <= 100 * s AND 100 * s <= {HIGH} * p
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, id) <= {NEGATIVES}"""
