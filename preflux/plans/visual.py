"""Queries of plot-ready frames and timing analytics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import benchstats, neighbours, visual
from . import views as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})


_POINTS = W.VECTORS + ", points AS (SELECT row_index, e[1] AS x, e[2] AS y, CAST(label AS DOUBLE) AS value FROM vectors)"


def points(spark, sf):
    return W.vectors(spark, sf).select("row_index", F.col("e")[0].alias("x"), F.col("e")[1].alias("y"), F.col("label").cast("double").alias("value"))


@query("WITH " + W.VECTORS + ", a AS (SELECT row_index, e, unnest(range(1, len(e) + 1)) AS i FROM vectors), b AS (SELECT i, e[i] AS x, e, unnest(range(1, len(e) + 1)) AS j FROM a) SELECT i - 1 AS i, j - 1 AS j, round(covar_samp(x, e[j]), 6) + 0.0 AS value FROM b GROUP BY ALL")
def covariance(spark, sf):
    return rounded(visual.covariance(W.vectors(spark, sf)), "value").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value")


@query()
def pca_2d(spark, sf):
    v = W.vectors(spark, sf)
    return visual.project(v, *visual.fit_pca(v, 2))


@query()
def embed_hashing(spark, sf):
    return visual.embed_hashing(W.poems(spark, sf), "text")


@query("WITH " + _POINTS + ", " + W.RATINGS + ", k AS (SELECT DISTINCT row_index FROM ratings) SELECT row_index, x, y FROM points ORDER BY CASE WHEN row_index IN (SELECT row_index FROM k) THEN 0 ELSE 1 END, CASE WHEN row_index IN (SELECT row_index FROM k) THEN NULL ELSE md5('0:' || row_index) END, row_index LIMIT 300")
def downsample(spark, sf):
    """300 points for a plot, the rated ones first."""
    return visual.downsample(points(spark, sf), W.ratings(spark, sf), 300).select("row_index", "x", "y")


@query("WITH " + _POINTS + """, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points), g AS (SELECT gx, gy, x0 - 0.05 * (x1 - x0) + gx * 1.1 * (x1 - x0) / 9 AS cx, y0 - 0.05 * (y1 - y0) + gy * 1.1 * (y1 - y0) / 9 AS cy FROM b, range(10) a(gx), range(10) c(gy)),
w AS (SELECT gx, gy, cx, cy, exp(-(pow(x - cx, 2) + pow(y - cy, 2)) / (2 * 0.1 * 0.1)) AS w, value FROM points, g) SELECT gx, gy, round(cx, 6) + 0.0 AS x, round(cy, 6) + 0.0 AS y, round(sum(w * value) / greatest(sum(w), 1e-12), 6) AS z FROM w GROUP BY ALL""")
def kde_heatmap(spark, sf):
    h = visual.heatmap(points(spark, sf), 10, 0.1)
    return rounded(h, "x", "y", "z").select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), "x", "y", "z")


_NY = int(60 / math.sqrt(3))


@query("WITH " + _POINTS + f""", b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points), p AS (SELECT value, (x - x0) / (x1 - x0) * 60 AS u, (y - y0) / (y1 - y0) * {_NY} AS v FROM points, b),
d AS (SELECT value, u, v, pow(u - floor(u + 0.5), 2) + 3 * pow(v - floor(v + 0.5), 2) < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS f FROM p)
SELECT CASE WHEN f THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN f THEN floor(u + 0.5) ELSE floor(u) END AS BIGINT) AS i, CAST(CASE WHEN f THEN floor(v + 0.5) ELSE floor(v) END AS BIGINT) AS j, count(*) AS n, round(avg(value), 6) AS mean FROM d GROUP BY ALL""")
def hexbin_mean(spark, sf):
    return rounded(visual.hexbin(points(spark, sf)), "mean")


_POETS = "(SELECT s_name AS poet, CAST(s_nationkey AS BIGINT) + 1 AS n_poems FROM supplier UNION ALL SELECT 'john keats', 5::BIGINT UNION ALL SELECT 'Emily  Dickinson', 9::BIGINT)"


@query(f"SELECT poet, n_poems, trim(regexp_replace(lower(poet), '\\s+', ' ', 'g')) IN ('john keats', 'emily dickinson') AS is_canonical, round((20 + 8 * sqrt(n_poems)) * CASE WHEN trim(regexp_replace(lower(poet), '\\s+', ' ', 'g')) IN ('john keats', 'emily dickinson') THEN 1.3 ELSE 1 END, 6) AS size FROM {_POETS} ORDER BY is_canonical DESC, n_poems DESC, poet LIMIT 20")
def poet_overlay(spark, sf):
    """Twenty authors to draw; suppliers stand for authors, and two canonical names join them."""
    poets = W.table(spark, sf, "supplier").selectExpr("s_name AS poet", "CAST(s_nationkey AS BIGINT) + 1 AS n_poems").unionByName(
        spark.createDataFrame([("john keats", 5), ("Emily  Dickinson", 9)], "poet string, n_poems long")
    )
    return rounded(visual.poet_overlay(poets, 20).select("poet", "n_poems", "is_canonical", "size"), "size")


@query(
    "WITH " + W.VECTORS + ", d AS (SELECT a.row_index, b.row_index AS neighbour, sqrt(greatest(list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e), 0)) AS distance FROM vectors a, vectors b WHERE a.row_index <> b.row_index)"
    " SELECT row_index, neighbour, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY row_index ORDER BY distance, neighbour) AS INT) AS rank FROM d QUALIFY rank <= 5"
)
def knn_graph(spark, sf):
    """The five nearest others of every vector, exactly."""
    return rounded(neighbours.exact_graph(W.vectors(spark, sf), 5), "distance").select("row_index", "neighbour", "distance", "rank")


@query()
def neighbour_layout(spark, sf):
    """All vectors in the plane, neighbours near each other."""
    v = W.vectors(spark, sf)
    return neighbours.layout(neighbours.knn_graph(v, 10), visual.project(v, *visual.fit_pca(v, 2)), 10)


def _labels_sql(where: str, most: str) -> str:
    """Greedy picks, in order, of the rated points of a kind, up to a number."""
    return _POINTS + ", " + W.RATINGS + f""", p AS (SELECT row_index, x, y, row_number() OVER (ORDER BY row_index) AS i FROM points JOIN ratings USING (row_index) WHERE {where}),
d AS (SELECT 0.04 * sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS gap FROM p),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(r BIGINT, x DOUBLE, y DOUBLE)[]) AS c UNION ALL SELECT p.i, CASE WHEN len(c) < {most} AND len([q FOR q IN c IF sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) < gap]) = 0 THEN list_append(c, CAST({{'r': row_index, 'x': p.x, 'y': p.y}} AS STRUCT(r BIGINT, x DOUBLE, y DOUBLE))) ELSE c END FROM g JOIN p ON p.i = g.i + 1, d),
picks AS (SELECT unnest(list_transform(c, lambda q: q.r)) AS row_index FROM (SELECT c FROM g ORDER BY i DESC LIMIT 1))"""


@query("WITH RECURSIVE " + _labels_sql("true", "12") + " SELECT CAST(row_number() OVER (ORDER BY row_index) - 1 AS INTEGER) AS n, row_index FROM picks")
def label_pick(spark, sf):
    """Labels for up to twelve of all rated points, each far enough from those before it."""
    chosen = visual.spaced_points(points(spark, sf).join(W.ratings(spark, sf), "row_index"), 12)
    return spark.createDataFrame(list(enumerate(chosen)), "n int, row_index long")


@query("WITH RECURSIVE " + _labels_sql("row_index % 50 <> 0", "12 - (SELECT least(12, count(*)) FROM points JOIN ratings USING (row_index) WHERE row_index % 50 = 0)") + " SELECT row_index FROM picks UNION SELECT row_index FROM (SELECT row_index FROM points JOIN ratings USING (row_index) WHERE row_index % 50 = 0 ORDER BY row_index LIMIT 12)")
def label_union(spark, sf):
    """Twelve labels: every fiftieth point stands for a canonical author's and comes first, the others are spread out among themselves."""
    rated = points(spark, sf).join(W.ratings(spark, sf), "row_index").withColumn("is_canonical", F.col("row_index") % 50 == 0)
    return spark.createDataFrame([(i,) for i in visual.label_points(rated, 12)], "row_index long")


@query("WITH " + W.TIMINGS + " SELECT m, count(*) AS n_runs, round(avg(fit_seconds), 6) AS mean_fit, min(fit_seconds) AS min_fit, round(avg(total_seconds), 6) AS mean_total, min(total_seconds) AS min_total FROM timings GROUP BY m")
def bench_by_size(spark, sf):
    return rounded(benchstats.by_size(W.timings(spark, sf)), "mean_fit", "mean_total")


@query("WITH " + W.TIMINGS + " SELECT backend, m, run, fit_seconds FROM (SELECT *, row_number() OVER (PARTITION BY backend, m ORDER BY run DESC) AS n FROM timings) WHERE n = 1")
def bench_latest(spark, sf):
    return benchstats.latest(W.timings(spark, sf), ["backend", "m"], ["run"]).select("backend", "m", "run", "fit_seconds")


@query("WITH " + W.TIMINGS + " SELECT DISTINCT m, nprocs FROM timings")
def bench_configs(spark, sf):
    return W.timings(spark, sf).select("m", "nprocs").distinct()


@query("WITH " + W.TIMINGS + " SELECT run, CASE WHEN nprocs <= 1 THEN 'single' ELSE 'distributed' END AS fit_backend, CASE WHEN nprocs <= 1 THEN 'Single' ELSE 'Distributed (n=' || nprocs || ', bs=' || block_size || ')' END AS backend_label FROM timings")
def bench_labels(spark, sf):
    return benchstats.with_labels(W.timings(spark, sf)).select("run", "fit_backend", "backend_label")


@query("WITH " + W.TIMINGS + ", a AS (SELECT m, nprocs, avg(fit_seconds) AS t FROM timings GROUP BY ALL) SELECT m, nprocs, round(t, 6) AS fit_seconds, round(b.t1 / t, 6) AS speedup, CAST(nprocs AS DOUBLE) AS ideal FROM a LEFT JOIN (SELECT m, t AS t1 FROM a WHERE nprocs = 1) b USING (m)")
def bench_speedup(spark, sf):
    return rounded(benchstats.speedup(W.timings(spark, sf)), "fit_seconds", "speedup")


@query("WITH " + W.TIMINGS + ", a AS (SELECT m, avg(fit_seconds) FILTER (backend = 'view') AS ta, avg(fit_seconds) FILTER (backend = 'click') AS tb FROM timings GROUP BY m) SELECT min(m) FILTER (tb < ta) AS first_m, count(*) FILTER (tb < ta) AS n_faster FROM a")
def bench_crossover(spark, sf):
    return benchstats.crossover(W.timings(spark, sf), "view", "click")


@query("WITH " + W.TIMINGS + ", a AS (SELECT backend, m, avg(fit_seconds) AS t FROM timings GROUP BY ALL) SELECT backend, m, round(t, 6) AS fit_seconds, round(t / lag(t) OVER w, 6) AS time_ratio, round(pow(m / lag(m) OVER w, 3), 6) AS expected_ratio FROM a WINDOW w AS (PARTITION BY backend ORDER BY m)")
def bench_scaling(spark, sf):
    return rounded(benchstats.scaling(W.timings(spark, sf), 3), "fit_seconds", "time_ratio", "expected_ratio")


@query("WITH " + W.TIMINGS + ", o AS (SELECT run, fit_seconds AS f, score_seconds AS s, select_seconds AS c, total_seconds AS t, greatest(total_seconds - (fit_seconds + score_seconds + select_seconds), 0) AS h FROM timings) SELECT run, round(h, 6) AS overhead_seconds, round(CASE WHEN t > 0 THEN 100 * f / t ELSE 0 END, 6) AS fit_pct, round(CASE WHEN t > 0 THEN 100 * s / t ELSE 0 END, 6) AS score_pct, round(CASE WHEN t > 0 THEN 100 * c / t ELSE 0 END, 6) AS select_pct, round(CASE WHEN t > 0 THEN 100 * h / t ELSE 0 END, 6) AS overhead_pct FROM o")
def bench_breakdown(spark, sf):
    names = ("overhead_seconds", "fit_pct", "score_pct", "select_pct", "overhead_pct")
    return rounded(benchstats.breakdown(W.timings(spark, sf)).select("run", *names), *names)
