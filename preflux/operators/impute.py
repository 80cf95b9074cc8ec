"""Missing metadata: first-line propagation, centroid similarity, and requests to and results from a language model."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vector as V
from ..sources import scratch
from . import gp

#: Prices of the cost estimate: tokens per request, and dollars per million.
TOKENS, DOLLARS = (175, 50), (0.25, 1.25)


def first_line_fill(poems: DataFrame) -> DataFrame:
    """(row_index, poet_new): the most frequent known author of the rows with the same first line, for rows without one.

    Ties go to the smallest name; a line needs two rows at least.
    """
    line = T.first_line(F.col("text"))
    missing = T.is_missing_poet(F.col("poet"))
    # Lines meet by their digest, so none is shuffled whole.
    rows = poems.select("row_index", F.unhex(F.md5(line)).alias("line"), F.when(~missing, F.col("poet")).alias("known"), missing.alias("missing"))
    votes = rows.groupBy("line", "known").agg(F.count("*").alias("n"))
    winner = F.min(F.when(F.col("known").isNotNull(), F.struct((-F.col("n")).alias("n"), "known"))).alias("first")
    lines = votes.groupBy("line").agg(F.sum("n").alias("n"), winner).where("n >= 2 AND first IS NOT NULL").select("line", F.col("first.known").alias("poet_new"))
    return rows.where("missing").join(lines, "line").select("row_index", "poet_new")


def group_centroids(vectors: DataFrame, group: str, min_rows: int) -> DataFrame:
    """(group, n_poems, centroid): the unit mean vector of each group of min_rows or more; a batch of rows gives one sum for each of its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                names = batch.column(0).dictionary_encode()
                sums = np.zeros((len(names.dictionary), V.batch_matrix(batch.column(1)).shape[1]))
                np.add.at(sums, names.indices.to_numpy(), V.batch_matrix(batch.column(1)))
                n = np.bincount(names.indices.to_numpy(), minlength=len(sums))
                yield pa.RecordBatch.from_arrays([names.dictionary, pa.array(n), pa.array(list(sums), pa.list_(pa.float64()))], ["name", "n", "sums"])

    parts = vectors.select(F.col(group), "e").where(F.col(group).isNotNull()).mapInArrow(run, "name string, n long, sums array<double>")
    cells = parts.select("name", "n", F.posexplode("sums").alias("i", "v")).groupBy("name", "i").agg(F.sum("v").alias("s"), F.sum("n").alias("n"))
    packed = cells.groupBy("name").agg(F.max("n").alias("n_poems"), F.sort_array(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("v")))).alias("cells"))
    return packed.where(F.col("n_poems") >= min_rows).select(F.col("name").alias(group), "n_poems", V.unit(F.transform("cells", lambda c: c["v"])).alias("centroid"))


#: Centroids of a ball on average, balls at most, and rows that share a copy of a ball.
BALL, PIVOTS, SHARE = 64, 4096, 65_536


def nearest_centroids(rows: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """(row_index, poet_new, similarity): for rows (row_index, u) the most similar of centroids (poet_new, centroid), if it reaches ``threshold``.

    Both are unit vectors, or zero. Centroids are dealt to balls around pivots that are centroids
    themselves. A row's distance to the nearest pivot, and the distance that the threshold means, bound how
    far its best can be; by the triangle inequality only balls that reach so near are looked at. Ties go to the smallest name.
    """
    looked = _looked_at(rows, centroids, threshold)
    best = looked.groupBy("row_index").agg(F.min(F.struct((-F.col("similarity")).alias("distance"), "poet_new")).alias("near"))
    return best.select("row_index", "near.poet_new", (-F.col("near.distance")).alias("similarity")).where(F.col("similarity") >= threshold)


def centroid_figures(rows: DataFrame, centroids: DataFrame, threshold: float) -> tuple[int, int]:
    """Dot products that ``nearest_centroids`` takes in balls, and those of all rows with all centroids."""
    return _looked_at(rows, centroids, threshold).agg(F.coalesce(F.sum("tried"), F.lit(0))).first()[0], rows.count() * centroids.count()


def _looked_at(rows: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """(row_index, poet_new, similarity, tried): each row's best in each ball that it looks at."""
    spark = rows.sparkSession
    held = scratch.written(centroids.select("poet_new", "centroid"), "centroids")
    k = max(1, min(PIVOTS, -(-held.count() // BALL)))
    pivots = np.array([r.centroid for r in held.orderBy(F.xxhash64("poet_new"), "poet_new").limit(k).collect()])
    if not len(pivots):
        return spark.createDataFrame([], "row_index long, poet_new string, similarity double, tried long")
    middle = spark.sparkContext.broadcast(pivots)

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(gp.squared_distances(x, middle.value))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = distances(V.batch_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1)), pa.array(d.min(1)), batch.column(0), batch.column(1)], ["leaf", "far", "poet_new", "u"])

    balls = scratch.written(held.select("poet_new", "centroid").mapInArrow(deal, "leaf long, far double, poet_new string, u array<double>"), "dealt")
    radii = np.full(len(pivots), -np.inf)
    for r in balls.groupBy("leaf").agg(F.max("far").alias("far")).collect():
        radii[r.leaf] = r.far
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    copies = max(1, -(-rows.count() // SHARE))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rounding, and zero vectors, which are nearer than their similarity of 0 says.
        slack = 1e-6
        for batch in batches:
            if len(batch):
                x = V.batch_matrix(batch.column(1))
                d = distances(x)
                within = np.minimum(d.min(1), reach if threshold > 0 else np.inf)
                row, leaf = np.nonzero(d - radii <= within[:, None] + slack)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["leaf", "row_index", "u"])

    asked = rows.select("row_index", "u").mapInArrow(ask, "leaf long, row_index long, u array<double>")
    copy = F.pmod(F.xxhash64("row_index"), F.lit(copies)).cast("int")
    both = balls.select("leaf", F.lit(None).cast("long").alias("row_index"), "u", "poet_new", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")).unionByName(
        asked.select("leaf", "row_index", "u", F.lit(None).cast("string").alias("poet_new"), copy.alias("copy"))
    )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, vectors = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            is_row = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.r_[(keys[1:] != keys[:-1]).any(1) | (is_row[1:] != is_row[:-1]), True]) + 1
            for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if tuple(keys[a]) != key:
                    key, names, vectors = tuple(keys[a]), [], []
                x = V.batch_matrix(batch.column(3).slice(a, b - a))
                if not is_row[a]:
                    names += batch.column(4).slice(a, b - a).to_pylist()
                    vectors.append(x)
                elif names:
                    order = np.argsort(np.array(names, object), kind="stable")
                    s = x @ np.concatenate(vectors)[order].T
                    top = s.argmax(1)
                    found = [pa.array([names[order[t]] for t in top]), pa.array(s[np.arange(len(s)), top]), pa.array(np.full(len(s), len(names), np.int64))]
                    yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), *found], ["row_index", "poet_new", "similarity", "tried"])

    dealt = both.select("leaf", "copy", "row_index", "u", "poet_new").repartition("leaf", "copy").sortWithinPartitions("leaf", "copy", F.col("row_index").isNotNull())
    return dealt.mapInArrow(best, "row_index long, poet_new string, similarity double, tried long")


def similarity_fill(vectors: DataFrame, group: str, threshold: float = 0.95, min_rows: int = 5) -> DataFrame:
    """(row_index, poet_new, similarity) for rows whose group is missing and whose best centroid is near enough. A zero vector has similarity 0."""
    known = vectors.where(~T.is_missing_poet(F.col(group)))
    centroids = group_centroids(known, group, min_rows).select(F.col(group).alias("poet_new"), "centroid")
    missing = vectors.where(T.is_missing_poet(F.col(group))).select("row_index", V.unit(F.col("e")).alias("u"))
    return nearest_centroids(missing, centroids, threshold)


def merge_fill(poems: DataFrame, fill: DataFrame, confidence: Column) -> DataFrame:
    """``poems`` with fills applied where the author was missing and not imputed, flags and confidence set."""
    joined = poems.join(fill, "row_index", "left")
    use = F.coalesce(T.is_missing_poet(F.col("poet")) & ~F.col("poet_imputed") & F.col("poet_new").isNotNull(), F.lit(False))
    return joined.withColumns(
        {
            "poet": F.when(use, F.col("poet_new")).otherwise(F.col("poet")),
            "poet_imputed": F.col("poet_imputed") | use,
            "poet_imputation_confidence": F.when(use, confidence).otherwise(F.col("poet_imputation_confidence")),
        }
    ).drop(*[c for c in fill.columns if c != "row_index"])


#: The parts of a prompt, around what is asked for, the passage, and the keys of the answer.
ASK = ("Which published poem does this passage open? Name ", ".\n\n---\n", "\n---\n\nAnswer with one JSON object and nothing else. Its keys are ")
CLOSE = '; confidence is "low", "medium" or "high". Use null, and low confidence, for what you do not know or what has no known author.'


def _prompt() -> Column:
    both, poet = F.col("needs_poet") & F.col("needs_title"), F.col("needs_poet")
    fields = F.when(both, "the author and the title").when(poet, "the author").otherwise("the title")
    keys = F.when(both, '"poet", "title" and "confidence"').when(poet, '"poet" and "confidence"').otherwise('"title" and "confidence"')
    return F.concat(F.lit(ASK[0]), fields, F.lit(ASK[1]), F.substring("text", 1, 1000), F.lit(ASK[2]), keys, F.lit(CLOSE))


def llm_requests(poems: DataFrame, model: str, max_poems: int | None = None) -> DataFrame:
    """(row_index, custom_id, request): one JSON request per row that needs author or title and has neither imputed."""
    need = poems.withColumns(
        {"needs_poet": T.is_missing_poet(F.col("poet")) & ~F.col("poet_imputed"), "needs_title": T.is_missing_title(F.col("title")) & ~F.col("title_imputed")}
    ).where("needs_poet OR needs_title")
    if max_poems is not None:
        need = need.orderBy("row_index").limit(max_poems)
    body = F.struct(F.lit(model).alias("model"), F.lit(200).alias("max_tokens"), F.array(F.struct(F.lit("user").alias("role"), _prompt().alias("content"))).alias("messages"))
    name = F.concat(F.lit("poem_"), F.col("row_index").cast("string"))
    return need.select("row_index", name.alias("custom_id"), F.to_json(F.struct(name.alias("custom_id"), body.alias("params"))).alias("request"))


def request_cost(requests: DataFrame) -> DataFrame:
    per = sum(t * d for t, d in zip(TOKENS, DOLLARS, strict=True)) / 1e6
    return requests.agg(F.count("*").alias("n_requests"), F.round(F.count("*") * per, 6).alias("estimated_dollars"))


_RESULT = "custom_id string, result struct<type:string, message:struct<content:array<struct<text:string>>>>"


def parse_llm_results(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with row_index, poet, title, confidence and error (null if the line is good)."""
    outer = F.from_json(line, _RESULT)
    inner_text = F.get(F.col("__o.result.message.content"), 0)["text"]
    kind = F.trim(F.col("__t"))
    out = lines.withColumn("__o", outer).withColumn("__t", inner_text)
    out = out.withColumn("__p", F.from_json("__t", "poet string, title string, confidence string"))
    index = F.regexp_extract(F.coalesce(F.col("__o.custom_id"), F.lit("")), "^poem_(-?[0-9]+)$", 1)
    bad = (
        F.when(index == "", "bad id or line")
        .when(F.coalesce(F.col("__o.result.type"), F.lit("")) != "succeeded", "not succeeded")
        .when(F.col("__t").isNull(), "no content")
        .when(~F.coalesce(kind.startswith("{") & (F.json_object_keys("__t").isNotNull()), F.lit(False)), "bad answer")
    )
    good = bad.isNull()
    return out.select(
        *lines.columns, F.when(index != "", index.try_cast("long")).alias("row_index"), *[F.when(good, F.col(f"__p.{c}")).alias(c) for c in ("poet", "title")],
        F.when(good, F.coalesce(F.col("__p.confidence"), F.lit("low"))).alias("confidence"), bad.alias("error"),
    )


def confidence_rank(c: Column) -> Column:
    return F.when(F.lower(c) == "high", 2).when(F.lower(c) == "medium", 1).otherwise(0)


def apply_llm_results(poems: DataFrame, parsed: DataFrame, min_confidence: int, order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(poems with answers applied, one row of counters).

    The first usable line of each (row, field) wins; later ones count as
    already imputed. Answers for rows that are not there are ignored.
    """
    flags = poems.select("row_index", "poet_imputed", "title_imputed")
    known = parsed.where("error IS NULL").join(flags, "row_index").withColumn("rank", confidence_rank(F.col("confidence")))
    sure = known.where(F.col("rank") >= min_confidence)
    usable = {
        "poet": F.coalesce((F.col("poet") != "") & ~F.lower("poet").isin("null", "none", "unknown"), F.lit(False)),
        "title": F.coalesce((F.col("title") != "") & ~F.lower("title").isin("null", "none", "untitled"), F.lit(False)),
    }
    for f, ok in usable.items():
        turn = F.row_number().over(Window.partitionBy("row_index", ok).orderBy(order))
        sure = sure.withColumn(f"{f}_usable", ok).withColumn(f"{f}_applied", ok & (turn == 1) & ~F.col(f"{f}_imputed"))
    totals = parsed.agg(F.count("*").alias("total_results"), F.count_if(F.col("error").isNotNull()).alias("parse_errors"))
    low = known.agg(F.count_if(F.col("rank") < min_confidence).alias("skipped_low_confidence"))
    done = sure.agg(
        (F.count_if(F.col("poet_usable") & ~F.col("poet_applied")) + F.count_if(F.col("title_usable") & ~F.col("title_applied"))).alias("skipped_already_imputed"),
        F.count_if("poet_applied").alias("applied_poet"), F.count_if("title_applied").alias("applied_title"), F.count_if(F.col("poet_applied") & F.col("title_applied")).alias("applied_both"),
    )
    picked = sure.groupBy("row_index").agg(
        *[F.max(F.when(F.col(f"{f}_applied"), F.struct(F.col(f).alias("v"), (F.col("rank") / 2.0).alias("c")))).alias(f"__{f}") for f in usable]
    )
    out = poems.join(picked, "row_index", "left")
    for f in usable:
        hit = F.col(f"__{f}").isNotNull()
        out = out.withColumns(
            {
                f: F.when(hit, F.col(f"__{f}.v")).otherwise(F.col(f)), f"{f}_imputed": F.col(f"{f}_imputed") | hit,
                f"{f}_imputation_confidence": F.when(hit, F.col(f"__{f}.c")).otherwise(F.col(f"{f}_imputation_confidence")),
            }
        )
    # Three single rows.
    return out.drop("__poet", "__title"), totals.crossJoin(low).crossJoin(done)
