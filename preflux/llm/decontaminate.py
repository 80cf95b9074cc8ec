"""Size-partitioned MinHash containment search for short test items inside long documents.

Items and documents are sets of hashed five-word shingles. Only shingles that
occur in some item can count towards containment, so documents are first cut
down to those (the only step that touches every word). What is left is
partitioned by size class; a class with at most u shingles and an item with q
have a Jaccard similarity of at least ``c / (u + q - c)`` when the document
holds c = ceil(0.8 q) of the item's shingles. From that bound each (class, item)
pair takes as many MinHash bands as leave a miss chance of ``MISS`` at most; a
pair that would need more than ``BANDS`` takes an exact posting join instead.
Every candidate is verified by exact shingle containment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialize, read

SHINGLE, CONTAINMENT = 5, 0.8
BANDS, MISS = 48, 1e-7
#: Item shingles are broadcast up to this many rows (16 bytes each); more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000
SEPARATORS = r"[^\p{L}\p{N}]+"


def item_words(col: Column) -> Column:
    """Lower-cased runs of letters and digits: punctuation glued to a passage's ends does not hide it."""
    return F.filter(F.split(ascii_lower(F.coalesce(col, F.lit(""))), SEPARATORS), lambda w: w != "")


def shingles(df: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """(key, shingle) for every run of k words, for each k of ``sizes``; repeats included."""
    hashed = df.select(key, F.transform(item_words(F.col(text)), lambda w: F.xxhash64(w)).alias("w"))
    out = None
    for k in sizes:
        at = hashed.where(F.size("w") >= k).select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("i"))
        part = at.select(key, F.xxhash64(F.lit(k), *[F.col("w")[F.col("i") + j] for j in range(k)]).alias("shingle"))
        out = part if out is None else out.unionByName(part)
    return out


def _signature(sets: DataFrame, key: str) -> DataFrame:
    """(key, n, sig): set size and the minimum of each hash function."""
    mins = [F.min(F.xxhash64("shingle", F.lit(b))).alias(f"m{b}") for b in range(BANDS)]
    return sets.groupBy(key).agg(F.count("*").alias("n"), *mins).select(key, "n", F.array(*[f"m{b}" for b in range(BANDS)]).alias("sig"))


def _bands(n_doc: Column, n_item: Column) -> Column:
    """MinHash bands for the size class of n_doc: 0 where only the exact way is sure enough."""
    top = F.pow(F.lit(2.0), F.floor(F.log2(n_doc)) + 1) - 1
    need = F.ceil(n_item * CONTAINMENT)
    jaccard = need / (top + n_item - need)
    bands = F.when(jaccard >= 1, F.lit(1)).otherwise(F.ceil(math.log(MISS) / F.log1p(-F.least(jaccard, F.lit(0.999999)))))
    return F.when(bands > BANDS, 0).otherwise(bands).cast("int")


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every pair at 0.8 or more.

    An item of fewer than five words is one shingle, its whole word sequence;
    an item without words matches nothing. Null texts have no words, rows with
    a null id are ignored, texts of one id are pooled, and extra columns are
    not looked at. No documents or no items give no rows.
    """
    its = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    lengths = its.select(F.least(F.size(item_words(F.col("text"))), F.lit(SHINGLE)).alias("k")).where("k > 0").distinct()
    sizes = sorted({r["k"] for r in lengths.collect()} | {SHINGLE})  # five values at most
    item_sets = None
    for k in sizes:
        own = its.where(F.least(F.size(item_words(F.col("text"))), F.lit(SHINGLE)) == k)
        part = shingles(own, "item_id", "text", [k])
        item_sets = part if item_sets is None else item_sets.unionByName(part)
    item_sets = materialize(item_sets.distinct(), "item-shingles")
    n_rows = item_sets.count()
    small = n_rows <= BROADCAST_SHINGLES

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    ds = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = shingles(ds, "doc_id", "text", sizes).join(side(item_sets.select("shingle").distinct()), "shingle", "left_semi").distinct()
    found = materialize(found, "document-shingles")

    doc_sig = _signature(found, "doc_id").withColumn("cls", F.floor(F.log2("n")).cast("int"))
    item_sig = _signature(item_sets, "item_id").withColumnsRenamed({"n": "n_item", "sig": "item_sig"})
    doc_sig = materialize(doc_sig, "document-signatures")
    classes = [r["cls"] for r in doc_sig.select("cls").distinct().collect()]  # at most 63 values
    probes = item_sig.withColumn("cls", F.explode(F.lit(classes).cast("array<int>") if classes else F.array().cast("array<int>"))).withColumn("bands", _bands(F.pow(F.lit(2.0), F.col("cls")), F.col("n_item")))
    probes = materialize(probes, "item-probes")

    item_bands = probes.where("bands > 0").select("item_id", "cls", F.posexplode(F.slice("item_sig", 1, F.col("bands"))).alias("band", "value"))
    doc_bands = doc_sig.select("doc_id", "cls", F.posexplode("sig").alias("band", "value"))
    by_hash = doc_bands.join(side(item_bands) if n_rows * BANDS <= BROADCAST_SHINGLES else item_bands, ["cls", "band", "value"]).select("doc_id", "item_id")
    exact_items = probes.where("bands = 0").select("item_id", "cls").join(item_sets, "item_id").select("item_id", "cls", "shingle")
    by_posting = found.join(doc_sig.select("doc_id", "cls"), "doc_id").join(exact_items, ["cls", "shingle"]).select("doc_id", "item_id")
    candidates = by_hash.unionByName(by_posting).distinct()

    sizes_of = item_sig.select("item_id", "n_item")
    shared = (
        candidates.join(found, "doc_id")
        .join(side(item_sets), ["item_id", "shingle"])
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("n_shared"))
    )
    out = (
        shared.join(side(sizes_of), "item_id")
        .withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))
        .where(F.col("n_shared") >= F.ceil(F.col("n_item") * CONTAINMENT))
        .select("doc_id", "item_id", "n_shared", "n_item", "containment")
    )
    out = materialize(out, "contained-items")
    for table in (item_sets, found, doc_sig, probes):
        discard(table)
    return out


def op7_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda w: w <> '')
  FROM benchmark WHERE item_id IS NOT NULL),
items AS (
  SELECT DISTINCT id AS item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT id, w, least(len(w), 5) AS k FROM words WHERE kind = 'i' AND len(w) > 0))),
docs AS (
  SELECT DISTINCT id AS doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM items) WHERE kind = 'd' AND len(w) >= k)),
n AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM shared JOIN n USING (item_id) WHERE n_shared >= ceil(n_item * 0.8)
"""
