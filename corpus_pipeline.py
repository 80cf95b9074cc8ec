"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``preflux.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes to the shared folder and reads again as the next stage's input. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preflux.llm import bpe, decontaminate, pii, quality
from preflux.llm.common import discard, materialize, read
from preflux.llm.near_copies import near_copies


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside its text, so that no column's name can clash with an operator's own."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside two hashes of it, which null and repeated ids leave distinct; rows equal in all columns share both.

    ``key`` names a row where 64 bits must do; ``check`` beside it tells rows apart whose keys agree by chance.
    """
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]
    return docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*hashed).alias("key"), F.xxhash64(F.lit("check"), *hashed).alias("check"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    rules = quality.fit_rules(docs, read(spark, sf_dir, "labels"))
    return quality.apply_rules(_packed(docs), rules).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 or more) stays: that with the smallest id, null ids last."""
    keyed = _keyed(docs)
    classes = near_copies(keyed.select("key", "row.text"), "key", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    ids = keyed.select("key", "row.doc_id").distinct()
    stay = materialize(classes.join(ids, "key").groupBy("component").agg(first).select("first.key"), "stay")
    return keyed.join(stay, "key", "left_semi").dropDuplicates(["key", "check"]).select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, each row judged by itself."""
    keyed = _keyed(docs)
    found = decontaminate.contained_items(keyed.select("key", "row.text"), read(spark, sf_dir, "benchmark"), "key").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(materialize(found, "contaminated"), "key", "left_anti").select("row.*")


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the text."""
    n_chars = F.length("masked_text").cast(docs.schema["n_chars"].dataType)
    row = F.col("row").withField("text", F.col("masked_text")).withField("n_chars", F.coalesce(n_chars, F.col("row.n_chars")))
    return pii.with_spans(_packed(docs)).select(row.alias("row")).select("row.*")


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and their decoding."""
    return bpe.encode(docs, bpe.vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("PII", personal_data_masked),
    ("BPE encoding and decoding", tokenized),
]

#: The learned rules, the hashes and the field can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
