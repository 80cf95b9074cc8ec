"""Ranked dedupe, duplicate reports and the corpus audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = (F.asc, "source_priority"), (F.desc, "metadata_score"), (F.desc, "text_len"), (F.asc, "poem_id")


def rank_duplicates(df: DataFrame, key: str = "text_hash_loose", min_chars: int = 80) -> DataFrame:
    """Rows of at least min_chars with dedupe_rank (0 is kept) and duplicate_group_size: one shuffle on the key."""
    own = Window.partitionBy(key)
    ranked = own.orderBy(*[f(c) for f, c in ORDER])
    return (
        df.where(F.col("text_len") >= min_chars)
        .withColumn("dedupe_rank", (F.row_number().over(ranked) - 1).cast("int"))
        .withColumn("duplicate_group_size", F.count("*").over(own))
        .withColumn("kept_representative", F.col("dedupe_rank") == 0)
    )


# The columns of the report, as far as the rows have them.
REPORT = (
    "text_hash_loose", "kept_representative", "dedupe_rank", "duplicate_group_size", "source_priority", "source_name", "source_kind", "source_location", "poem_id", "source_row_id",
    "title", "poet", "text_len", "license_family", "normalized_title", "normalized_poet", "text_hash", "title_poet_key", "title_poet_text_key",
)


def duplicate_report(ranked: DataFrame) -> DataFrame:
    """Every ranked row with the columns of REPORT, by group, the kept row first."""
    order = F.asc("text_hash_loose"), F.desc("kept_representative"), F.asc("source_priority"), F.asc("poem_id")
    return ranked.select(*[c for c in REPORT if c in ranked.columns]).orderBy(*order)


def _place() -> Column:
    """What orders the rows of a group, as one value whose least is the kept row."""
    return F.struct("source_priority", (-F.col("metadata_score")).alias("m"), (-F.col("text_len")).alias("l"), "poem_id", "source_name")


def kept_rows(df: DataFrame, key: str = "text_hash_loose", min_chars: int = 80) -> DataFrame:
    """(poem_id, source_name, key, duplicate_group_size) of each group's kept row: an aggregate, so a large group is summed up before the shuffle."""
    groups = df.where(F.col("text_len") >= min_chars).groupBy(key).agg(F.min(_place()).alias("first"), F.count("*").alias("duplicate_group_size"))
    return groups.select("first.poem_id", "first.source_name", key, "duplicate_group_size")


def group_sources(df: DataFrame, key: str = "text_hash_loose", min_chars: int = 80) -> DataFrame:
    """(key, source_name, n, first, sources) per group and source: its rows, the group's kept row, and how many sources the group has."""
    by_source = df.where(F.col("text_len") >= min_chars).groupBy(key, "source_name").agg(F.count("*").alias("n"), F.min(_place()).alias("first"))
    own = Window.partitionBy(key)  # rows of sources now, not of texts
    return by_source.withColumns({"first": F.min("first").over(own), "sources": F.count("*").over(own)})


def dedupe_summary(df: DataFrame, key: str = "text_hash_loose", min_chars: int = 80) -> DataFrame:
    """Four stages with their row counts, from one pass over distinct keys."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("text_len") >= min_chars).alias("m"))
    total = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("a"), F.coalesce(F.sum("m"), F.lit(0)).alias("b"), F.count_if(F.col("m") > 0).alias("c")
    )
    return total.selectExpr("stack(4, 'input_rows', a, 'after_min_chars', b, 'deduped_rows', c, 'removed_as_duplicates', b - c) AS (stage, n_rows)")


def source_summary(audit: DataFrame, df: DataFrame) -> DataFrame:
    """What each source contributed: rows kept and dropped, groups won, lost, touched and contested, rates."""
    touched = group_sources(df).withColumn("kept", (F.col("first.source_name") == F.col("source_name")).cast("long")).withColumn("dropped", F.col("n") - F.col("kept"))
    counts = touched.groupBy("source_name").agg(
        F.sum("kept").alias("kept_rows"), F.sum("dropped").alias("dropped_rows"), F.count_if(F.col("kept") > 0).alias("groups_won"), F.count_if(F.col("dropped") > 0).alias("groups_lost"),
        F.count("*").alias("groups_touched"), F.count_if(F.col("sources") > 1).alias("conflict_groups_touched"),
    )
    names = ("kept_rows", "dropped_rows", "groups_won", "groups_lost", "groups_touched", "conflict_groups_touched")
    joined = audit.join(counts, "source_name", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})

    def rate(a: str, b: str):
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    return joined.withColumns(
        {
            "retention_rate_from_canonical": rate("kept_rows", "rows_canonical"),
            "drop_rate_from_canonical": rate("dropped_rows", "rows_canonical"),
            "conflict_group_rate": rate("conflict_groups_touched", "groups_touched"),
        }
    )


def source_overlap(df: DataFrame) -> DataFrame:
    """(source_a, source_b, shared_duplicate_groups): groups that both sources touch."""
    names = df.where(F.col("text_len") >= 80).groupBy("text_hash_loose").agg(F.sort_array(F.collect_set("source_name")).alias("names")).where(F.size("names") > 1)
    first = names.select("names", F.posexplode("names").alias("i", "source_a"))
    pairs = first.select("source_a", F.explode(F.expr("slice(names, i + 2, size(names))")).alias("source_b"))
    return pairs.groupBy("source_a", "source_b").agg(F.count("*").alias("shared_duplicate_groups"))


def source_winloss(df: DataFrame) -> DataFrame:
    """(winner_source, loser_source, duplicate_groups_won) over groups of two sources or more; a source can lose to itself."""
    lost = F.col("n") > (F.col("first.source_name") == F.col("source_name")).cast("long")
    return (
        group_sources(df)
        .where((F.col("sources") > 1) & lost)
        .groupBy(F.col("first.source_name").alias("winner_source"), F.col("source_name").alias("loser_source"))
        .agg(F.count("*").alias("duplicate_groups_won"))
    )
