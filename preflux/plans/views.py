"""The tables of the driver seen as the engine's own, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def poems(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as poems; every seventh has an unknown author."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS row_index", "source || ':' || doc_id AS poem_id", "source AS source_name", "CAST(substr(source, 4) AS INT) AS source_priority", "lang AS source_language",
        "text", "trim(split_part(trim(text), '\n', 1)) AS title", "CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE source END AS poet",
    )


POEMS = """poems AS (
  SELECT doc_id AS row_index, source || ':' || doc_id AS poem_id, source AS source_name, CAST(substr(source, 4) AS INT) AS source_priority, lang AS source_language, text,
         trim(split_part(trim(text), chr(10), 1)) AS title, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE source END AS poet FROM documents)"""

# The tables hold no tabs, carriage returns, runs of spaces or typographic quotes, so the plain forms agree.
KEYED = (
    POEMS
    + r""", keyed AS (
  SELECT row_index, poem_id, source_name, source_priority, source_language,
         trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, poet, body AS text,
         trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS normalized_title, lower(poet) AS normalized_poet,
         sha1(body) AS text_hash, sha1(trim(regexp_replace(lower(body), '\s+', ' ', 'g'))) AS text_hash_loose,
         length(body) AS text_len, CAST(length(title) > 0 AS INT) + CAST(length(poet) > 0 AS INT) + CAST(length(body) > 0 AS INT) AS metadata_score
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '[^\S\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS body FROM poems))"""
)
RANKED = (
    KEYED
    + """, ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY text_hash_loose ORDER BY source_priority, metadata_score DESC, text_len DESC, poem_id) - 1 AS INT) AS dedupe_rank,
         count(*) OVER (PARTITION BY text_hash_loose) AS duplicate_group_size FROM keyed WHERE length(text) >= 80)"""
)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_index"), V.doubles("embedding").alias("e"), "label")


VECTORS = "vectors AS (SELECT vec_id AS row_index, embedding::DOUBLE[] AS e, label FROM embeddings)"


#: Liked, neutral or disliked by value.
LIKED = "CAST(CASE WHEN value >= 100 THEN 1 WHEN value >= 30 THEN 0 ELSE -1 END AS DOUBLE)"


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases rate the vector of their number."""
    return table(spark, sf, "events").where("event_type = 'purchase'").selectExpr(
        "event_id AS row_index", LIKED + " AS rating"
    )


RATINGS = "ratings AS (SELECT event_id AS row_index, " + LIKED + " AS rating FROM events WHERE event_type = 'purchase')"


def rated_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).join(ratings(spark, sf), "row_index")


RATED = VECTORS + ", " + RATINGS + ", rated AS (SELECT row_index, e, label, rating, row_number() OVER (ORDER BY row_index) AS i FROM vectors JOIN ratings USING (row_index))"

#: The posterior by Gauss and Jordan's elimination of [K + noise^2 I | I] in a recursive query.
POSTERIOR = (
    RATED
    + """, size AS (SELECT count(*) AS n FROM rated),
kernel AS (SELECT a.i AS i, b.i AS j, exp(-greatest(list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e), 0) / 2) + CASE WHEN a.i = b.i THEN 1e-6 ELSE 0 END AS k FROM rated a, rated b),
rows_of AS (SELECT i, list(k ORDER BY j) || list(CASE WHEN i = j THEN 1.0 ELSE 0.0 END ORDER BY j) AS r FROM kernel GROUP BY i),
start AS (SELECT list(r ORDER BY i) AS m FROM rows_of),
gj(k, n, m, logdet) AS (
  SELECT 1, n, m, 0.0::DOUBLE FROM start, size
  UNION ALL
  SELECT k + 1, n, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k]) ELSE list_transform(row, lambda v, j: v - row[k] * m[k][j] / m[k][k]) END), logdet + ln(m[k][k])
  FROM gj WHERE k <= n),
inverse AS (SELECT list_transform(m, lambda row: row[n + 1:2 * n]) AS inv, logdet, n FROM gj WHERE k = n + 1),
y AS (SELECT list(rating ORDER BY i) AS y FROM rated),
alpha AS (SELECT list_transform(inv, lambda row: list_dot_product(row, y)) AS a, inv, logdet, n, y FROM inverse, y),
cross_kernel AS (SELECT v.row_index, list(exp(-greatest(list_dot_product(v.e, v.e) + list_dot_product(r.e, r.e) - 2 * list_dot_product(v.e, r.e), 0) / 2) ORDER BY r.i) AS k FROM vectors v, rated r GROUP BY v.row_index),
posterior AS (SELECT row_index, list_dot_product(k, a) AS mean, greatest(1 - list_dot_product(k, list_transform(inv, lambda row: list_dot_product(row, k))), 0) AS variance FROM cross_kernel, alpha),
free AS (SELECT * FROM posterior WHERE row_index NOT IN (SELECT row_index FROM rated))"""
)


def timings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as timing records: size and processes from the user, parts of the total from the value."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS run", "100 * (1 + user_id % 8) AS m", "event_type AS backend", "CAST(power(2, user_id % 5) AS INT) AS nprocs", "CAST(64 * (1 + user_id % 3) AS INT) AS block_size",
        "value AS fit_seconds", "value / 2 AS score_seconds", "value / 10 AS select_seconds", "value * 2 AS total_seconds",
    )


TIMINGS = "timings AS (SELECT event_id AS run, 100 * (1 + user_id % 8) AS m, event_type AS backend, CAST(power(2, user_id % 5) AS INT) AS nprocs, CAST(64 * (1 + user_id % 3) AS INT) AS block_size, value AS fit_seconds, value / 2 AS score_seconds, value / 10 AS select_seconds, value * 2 AS total_seconds FROM events)"

_ANSWER = """'{"poet": ' || CASE WHEN {i} % 5 = 0 THEN 'null' ELSE '"Author ' || {i} || '"' END || ', "title": ' || CASE WHEN {i} % 3 = 0 THEN '"untitled"' ELSE '"Title ' || {i} || '"' END || ', "confidence": "' || CASE {i} % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END || '"}'"""
_LINE = """CASE WHEN {i} % 33 = 0 THEN '{"custom_id": "poem_' || {i} || '", "result": {"type": "errored"}}' WHEN {i} % 33 = 11 THEN 'not json' WHEN {i} % 33 = 22 THEN '{"custom_id": "poem_' || {i} || '", "result": {"type": "succeeded", "message": {"content": []}}}'
 ELSE '{"custom_id": "poem_' || {i} || '", "result": {"type": "succeeded", "message": {"content": [{"text": "' || replace({a}, '"', '{q}') || '"}]}}}' END"""


def _line(i: str, quote: str) -> str:
    return _LINE.replace("{a}", _ANSWER).replace("{q}", quote).replace("{i}", i)


def llm_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A result line for every document; some are malformed, some name no author."""
    return table(spark, sf, "documents").selectExpr("doc_id AS line_no", _line("doc_id", '\\\\"') + " AS value")


LLM_LINES = "lines AS (SELECT doc_id AS line_no, " + _line("doc_id", '\\"') + " AS value FROM documents)"
