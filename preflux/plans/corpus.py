"""Queries over the corpus: scans, text, dedupe, audit, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, encoder, impute
from ..sources import readers
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


def keyed(spark, sf):
    return readers.with_keys(W.poems(spark, sf))


def ranked(spark, sf):
    return corpus.rank_duplicates(keyed(spark, sf))


def audit(spark, sf):
    return W.poems(spark, sf).groupBy("source_name").agg(F.count("*").alias("rows_loaded"), F.count("*").alias("rows_canonical"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT vec_id, len(embedding) AS dim, label FROM embeddings")
def scan_embeddings(spark, sf):
    return W.table(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"), "label")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 10")
def per_source_limit(spark, sf):
    """The first ten rows of each source: the limit is the feature."""
    return readers.first_rows_by(W.table(spark, sf, "documents").select("doc_id", "source"), "source", 10, ["doc_id"])


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(text, 1, 300) AS text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents ORDER BY documents.doc_id LIMIT 5")
def inspect_dataset(spark, sf):
    return readers.inspect(W.table(spark, sf, "documents"), 5, ["doc_id"])


@query("SELECT CAST(doc_id AS VARCHAR) AS poem_id, '' AS title, '' AS poet, coalesce(text, '') AS text FROM documents")
def canonicalize(spark, sf):
    return readers.canonicalize(W.table(spark, sf, "documents").withColumnRenamed("doc_id", "id"))


@query(
    "WITH " + W.KEYED + " SELECT poem_id, text_hash, text_hash_loose, sha1(normalized_title || chr(10) || normalized_poet) AS title_poet_key,"
    " sha1(normalized_title || chr(10) || normalized_poet || chr(10) || text_hash_loose) AS title_poet_text_key, CAST(text_len AS INT) AS text_len, metadata_score FROM keyed"
)
def provenance_keys(spark, sf):
    return keyed(spark, sf).select("poem_id", "text_hash", "text_hash_loose", "title_poet_key", "title_poet_text_key", "text_len", "metadata_score")


@query("WITH " + W.KEYED + " SELECT poem_id, CAST(text_len AS INT) AS text_len FROM keyed WHERE length(text) >= 80")
def min_chars_filter(spark, sf):
    return keyed(spark, sf).where(F.length("text") >= 80).select("poem_id", "text_len")


_MISSING_POET = "(" + ", ".join(f"'{x}'" for x in T.MISSING_POETS) + ")"
_MISSING_TITLE = "(" + ", ".join(f"'{x}'" for x in T.MISSING_TITLES) + ")"


@query(
    "WITH " + W.POEMS + rf" SELECT count(*) AS n_rows, count(*) FILTER (poet IS NULL OR lower(trim(poet)) IN {_MISSING_POET}) AS missing_poet,"
    rf" count(*) FILTER (title IS NULL OR trim(regexp_replace(lower(title), '\s+', ' ', 'g')) IN {_MISSING_TITLE}) AS missing_title FROM poems"
)
def missing_metadata_stats(spark, sf):
    return W.poems(spark, sf).agg(
        F.count("*").alias("n_rows"), F.count_if(T.is_missing_poet(F.col("poet"))).alias("missing_poet"), F.count_if(T.is_missing_title(F.col("title"))).alias("missing_title")
    )


@query("WITH " + W.POEMS + " SELECT row_index, poet FROM poems WHERE lower(trim(poet)) NOT IN (" + ", ".join(f"'{x}'" for x in ("", *T.UNUSABLE_POETS)) + ") AND lower(trim(poet)) NOT LIKE 'anonymous %' AND lower(trim(poet)) NOT LIKE 'unknown %'")
def valid_poet_filter(spark, sf):
    return W.poems(spark, sf).where(T.is_usable_poet(F.col("poet"))).select("row_index", "poet")


_AUTHORS = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(list_extract([{0}], CAST(c_custkey % {1} AS INT) + 1)) ELSE c_name END AS poet FROM customer)"


@query("SELECT id, poet, lower(trim(poet)) IN ({0}) AS is_canonical FROM ".format(", ".join(f"'{p}'" for p in T.CANONICAL_POETS)) + _AUTHORS.format(", ".join(f"'{p}'" for p in T.CANONICAL_POETS), len(T.CANONICAL_POETS)))
def canonical_poets(spark, sf):
    """Membership in the curated list; every third customer stands for one of its authors."""
    n = len(T.CANONICAL_POETS)
    name = F.element_at(F.lit(list(T.CANONICAL_POETS)), (F.col("c_custkey") % n).cast("int") + 1)
    authors = W.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.upper(name)).otherwise(F.col("c_name")).alias("poet"))
    return authors.withColumn("is_canonical", T.is_canonical(F.col("poet")))


@query("WITH " + W.POEMS + " SELECT row_index, poem_id FROM poems WHERE contains(upper(title), 'THE') OR contains(upper(poet), 'THE') OR contains(upper(text), 'THE') ORDER BY row_index LIMIT 10")
def search_documents(spark, sf):
    """A keyword search shows the first ten hits."""
    hit = T.contains_literal(F.col("title"), "the") | T.contains_literal(F.col("poet"), "the") | T.contains_literal(F.col("text"), "the")
    return W.poems(spark, sf).where(hit).orderBy("row_index").limit(10).select("row_index", "poem_id")


@query("WITH " + W.POEMS + " SELECT row_index, title FROM poems WHERE contains(upper(title), 'THAT') ORDER BY row_index LIMIT 1")
def title_lookup(spark, sf):
    return W.poems(spark, sf).where(T.contains_literal(F.col("title"), "that")).orderBy("row_index").limit(1).select("row_index", "title")


@query("WITH " + W.POEMS + " SELECT row_index, CASE WHEN poet IN ('src1', 'src2') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM poems WHERE poet IN ('src1', 'src2', 'src3')")
def proxy_labels(spark, sf):
    y = F.when(F.col("poet").isin("src1", "src2"), 1.0).when(F.col("poet").isin("src3"), -1.0)
    return W.poems(spark, sf).withColumn("y", y).where("y IS NOT NULL").select("row_index", "y")


@query("WITH " + W.POEMS + " SELECT row_index, coalesce(nullif(trim(title), ''), 'Untitled') AS title, coalesce(nullif(trim(poet), ''), 'Unknown') AS poet, substr(text, 1, 4000) AS body, substr(replace(text, chr(10), ' '), 1, 60) AS excerpt FROM poems")
def display_projection(spark, sf):
    def shown(c, default):
        return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default)).alias(c)

    return W.poems(spark, sf).select("row_index", shown("title", "Untitled"), shown("poet", "Unknown"), F.substring("text", 1, 4000).alias("body"), F.substring(F.translate("text", "\n", " "), 1, 60).alias("excerpt"))


@query("WITH " + W.KEYED + r" SELECT row_index, text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS text_loose FROM keyed")
def normalize_text(spark, sf):
    return keyed(spark, sf).select("row_index", "text", F.col("normalized_text_loose").alias("text_loose"))


@query("SELECT doc_id, sha1(text) AS text_sha1 FROM documents")
def text_hashes(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("text_sha1"))


_LINES = W.POEMS + ", lined AS (SELECT *, lower(trim(split_part(trim(text), chr(10), 1))) AS line FROM poems)"


@query("WITH " + _LINES + " SELECT line, count(*) AS n FROM lined GROUP BY line HAVING count(*) >= 2")
def first_line_groups(spark, sf):
    return W.poems(spark, sf).groupBy(T.first_line(F.col("text")).alias("line")).agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT 'documents' AS source_name, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), text FROM benchmark UNION ALL SELECT 'conversations', conv_id || '-' || turn, text FROM conversations")
def combine_sources(spark, sf):
    parts = [("documents", "CAST(doc_id AS STRING)"), ("benchmark", "CAST(item_id AS STRING)"), ("conversations", "conv_id || '-' || turn")]
    return readers.combine([W.table(spark, sf, n).selectExpr(f"'{n}' AS source_name", f"{i} AS id", "text") for n, i in parts])


_SOURCES = ("documents", "conversations", "benchmark")


@query(" UNION ALL ".join(f"SELECT '{t}' AS source_name, 'parquet' AS source_kind, count(*) AS rows_loaded, count(*) AS rows_canonical, 'DetectedColumns(poem_id=None, title=None, poet=None, text=''text'')' AS detected_columns FROM {t}" for t in _SOURCES))
def source_audit(spark, sf):
    """What loading three tables as the sources of a manifest reports of each."""
    specs = [readers.SourceSpec(t, "parquet", f"{sf}/{t}.parquet", priority=i) for i, t in enumerate(_SOURCES)]
    return readers.load_sources(spark, specs)[1].drop("source_location")


@query("WITH " + W.RANKED + " SELECT poem_id, text_hash_loose, duplicate_group_size FROM ranked WHERE dedupe_rank = 0")
def dedupe_kept(spark, sf):
    return corpus.kept_rows(keyed(spark, sf)).drop("source_name")


@query("WITH " + W.RANKED + " SELECT poem_id, text_hash_loose, dedupe_rank FROM ranked WHERE dedupe_rank > 0")
def dedupe_dropped(spark, sf):
    return ranked(spark, sf).where("NOT kept_representative").select("poem_id", "text_hash_loose", "dedupe_rank")


@query("WITH " + W.RANKED + " SELECT 'input_rows' AS stage, (SELECT count(*) FROM keyed) AS n_rows UNION ALL SELECT 'after_min_chars', (SELECT count(*) FROM ranked) UNION ALL SELECT 'deduped_rows', (SELECT count(*) FROM ranked WHERE dedupe_rank = 0) UNION ALL SELECT 'removed_as_duplicates', (SELECT count(*) FROM ranked WHERE dedupe_rank > 0)")
def dedupe_summary(spark, sf):
    return corpus.dedupe_summary(keyed(spark, sf))


@query(
    "WITH " + W.RANKED + " SELECT text_hash_loose, dedupe_rank = 0 AS kept_representative, dedupe_rank, duplicate_group_size, source_priority, source_name, 'parquet' AS source_kind, 'documents' AS source_location, poem_id,"
    " CAST(row_index AS VARCHAR) AS source_row_id, title, poet, CAST(text_len AS INT) AS text_len, 'invented' AS license_family, normalized_title, normalized_poet, text_hash, sha1(normalized_title || chr(10) || normalized_poet) AS title_poet_key,"
    " sha1(normalized_title || chr(10) || normalized_poet || chr(10) || text_hash_loose) AS title_poet_text_key FROM ranked"
)
def duplicate_groups(spark, sf):
    about = {"source_kind": F.lit("parquet"), "source_location": F.lit("documents"), "license_family": F.lit("invented"), "source_row_id": F.col("row_index").cast("string")}
    return corpus.duplicate_report(ranked(spark, sf).withColumns(about))


@query(
    "WITH " + W.RANKED + """, g AS (SELECT *, dedupe_rank = 0 AS kept FROM ranked), c AS (SELECT text_hash_loose FROM g GROUP BY 1 HAVING count(DISTINCT source_name) > 1),
s AS (SELECT source_name, count(*) FILTER (kept) AS kept_rows, count(*) FILTER (NOT kept) AS dropped_rows, count(DISTINCT text_hash_loose) FILTER (kept) AS groups_won, count(DISTINCT text_hash_loose) FILTER (NOT kept) AS groups_lost,
 count(DISTINCT text_hash_loose) AS groups_touched, count(DISTINCT text_hash_loose) FILTER (text_hash_loose IN (SELECT text_hash_loose FROM c)) AS conflict_groups_touched FROM g GROUP BY source_name),
a AS (SELECT source_name, count(*) AS rows_loaded, count(*) AS rows_canonical FROM poems GROUP BY source_name)
SELECT a.*, coalesce(kept_rows, 0) AS kept_rows, coalesce(dropped_rows, 0) AS dropped_rows, coalesce(groups_won, 0) AS groups_won, coalesce(groups_lost, 0) AS groups_lost, coalesce(groups_touched, 0) AS groups_touched, coalesce(conflict_groups_touched, 0) AS conflict_groups_touched,
 round(coalesce(kept_rows / nullif(rows_canonical, 0), 0), 6) AS retention_rate_from_canonical, round(coalesce(dropped_rows / nullif(rows_canonical, 0), 0), 6) AS drop_rate_from_canonical, round(coalesce(conflict_groups_touched / nullif(groups_touched, 0), 0), 6) AS conflict_group_rate
FROM a LEFT JOIN s USING (source_name)"""
)
def source_summary(spark, sf):
    out = corpus.source_summary(audit(spark, sf), keyed(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("retention_rate_from_canonical", "drop_rate_from_canonical", "conflict_group_rate")})


@query("WITH " + W.RANKED + ", p AS (SELECT DISTINCT text_hash_loose, source_name FROM ranked) SELECT a.source_name AS source_a, b.source_name AS source_b, count(*) AS shared_duplicate_groups FROM p a JOIN p b USING (text_hash_loose) WHERE a.source_name < b.source_name GROUP BY ALL")
def source_overlap(spark, sf):
    return corpus.source_overlap(keyed(spark, sf))


@query("WITH " + W.RANKED + ", g AS (SELECT text_hash_loose, min(source_name) FILTER (dedupe_rank = 0) AS winner_source FROM ranked GROUP BY 1 HAVING count(DISTINCT source_name) > 1), l AS (SELECT DISTINCT text_hash_loose, source_name AS loser_source FROM ranked WHERE dedupe_rank > 0) SELECT winner_source, loser_source, count(*) AS duplicate_groups_won FROM l JOIN g USING (text_hash_loose) GROUP BY ALL")
def source_winloss(spark, sf):
    return corpus.source_winloss(keyed(spark, sf))


@query("WITH " + W.POEMS + " SELECT poet, count(*) AS n_poems FROM poems GROUP BY poet HAVING count(*) >= 3")
def poet_counts(spark, sf):
    return W.poems(spark, sf).groupBy("poet").agg(F.count("*").alias("n_poems")).where("n_poems >= 3")


@query("WITH " + W.POEMS + " SELECT poet, count(*) AS n_poems FROM poems GROUP BY poet ORDER BY n_poems DESC, poet LIMIT 10")
def top_poets(spark, sf):
    return W.poems(spark, sf).groupBy("poet").agg(F.count("*").alias("n_poems")).orderBy(F.desc("n_poems"), "poet").limit(10)


_FILL = _LINES + """, votes AS (SELECT line, poet, count(*) AS n FROM lined WHERE poet <> 'unknown' GROUP BY ALL), best AS (SELECT line, poet FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY n DESC, poet) AS k FROM votes) WHERE k = 1),
fill AS (SELECT row_index, best.poet AS poet_new FROM lined JOIN best USING (line) WHERE lined.poet = 'unknown')"""


@query("WITH " + _FILL + " SELECT row_index, poet_new FROM fill")
def impute_first_line(spark, sf):
    return impute.first_line_fill(W.poems(spark, sf))


def with_flags(p):
    return p.withColumns({"poet_imputed": F.lit(False), "title_imputed": F.lit(False), "poet_imputation_confidence": F.lit(0.0), "title_imputation_confidence": F.lit(0.0)})


@query("WITH " + _FILL + " SELECT count(*) AS n_rows, count(*) FILTER (poet = 'unknown') AS missing_before, (SELECT count(*) FROM fill) AS filled, count(*) FILTER (poet = 'unknown') - (SELECT count(*) FROM fill) AS missing_after FROM poems")
def impute_summary(spark, sf):
    p = with_flags(W.poems(spark, sf))
    before = p.select("row_index", T.is_missing_poet(F.col("poet")).alias("was"))
    done = impute.merge_fill(p, impute.first_line_fill(p), F.lit(0.0)).join(before, "row_index")
    return done.agg(F.count("*").alias("n_rows"), F.count_if("was").alias("missing_before"), F.count_if("poet_imputed").alias("filled"), F.count_if(T.is_missing_poet(F.col("poet"))).alias("missing_after"))


_MISSING = W.VECTORS + ", known AS (SELECT *, CASE WHEN row_index % 7 = 0 THEN NULL ELSE 'poet' || label END AS poet FROM vectors)"
_CENTROIDS = """, cells AS (SELECT poet, i, avg(e[i]) AS v, count(*) AS n FROM (SELECT poet, e, unnest(range(1, len(e) + 1)) AS i FROM known WHERE poet IS NOT NULL) GROUP BY poet, i),
raw AS (SELECT poet, max(n) AS n_poems, list(v ORDER BY i) AS c FROM cells GROUP BY poet),
centroids AS (SELECT poet, n_poems, list_transform(c, lambda v: v / sqrt(list_dot_product(c, c))) AS centroid FROM raw WHERE n_poems >= {n})"""


def authored_vectors(spark, sf):
    return W.vectors(spark, sf).withColumn("poet", F.when(F.col("row_index") % 7 == 0, None).otherwise(F.concat(F.lit("poet"), F.col("label").cast("string"))))


@query("WITH " + _MISSING + _CENTROIDS.format(n=5) + ", near AS (SELECT k.row_index, c.poet AS poet_new, list_dot_product(k.e, c.centroid) / sqrt(list_dot_product(k.e, k.e)) AS s FROM known k, centroids c WHERE k.poet IS NULL) SELECT row_index, poet_new, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY s DESC, poet_new) AS n FROM near) WHERE n = 1 AND s >= 0.3")
def impute_similarity(spark, sf):
    return impute.similarity_fill(authored_vectors(spark, sf), "poet", 0.3).withColumn("similarity", F.round("similarity", 6))


@query("WITH " + _MISSING + _CENTROIDS.format(n=3) + " SELECT poet, n_poems, i - 1 AS i, round(centroid[i], 6) + 0.0 AS v FROM (SELECT *, unnest(range(1, len(centroid) + 1)) AS i FROM centroids)")
def poet_centroids(spark, sf):
    known = authored_vectors(spark, sf).where(T.is_usable_poet(F.col("poet")))
    return impute.group_centroids(known, "poet", 3).select("poet", "n_poems", F.posexplode("centroid").alias("i", "v")).select("poet", "n_poems", F.col("i").cast("long").alias("i"), (F.round("v", 6) + 0.0).alias("v"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_PROMPT = (
    f"{_quoted(impute.ASK[0])} || CASE WHEN a AND t THEN 'the author and the title' WHEN a THEN 'the author' ELSE 'the title' END || {_quoted(impute.ASK[1])} || substr(text, 1, 1000) || {_quoted(impute.ASK[2])}"
    f" || CASE WHEN a AND t THEN '\"poet\", \"title\" and \"confidence\"' WHEN a THEN '\"poet\" and \"confidence\"' ELSE '\"title\" and \"confidence\"' END || {_quoted(impute.CLOSE)}"
)


@query(
    "WITH " + W.POEMS + ", r AS (SELECT row_index, text, poet = 'unknown' AS a, title = '' OR lower(title) IN " + _MISSING_TITLE + " AS t FROM poems)"
    " SELECT 'poem_' || row_index AS custom_id, row_index, CAST(to_json({'custom_id': 'poem_' || row_index, 'params': {'model': 'any-model', 'max_tokens': 200, 'messages': [{'role': 'user', 'content': " + _PROMPT + "}]}}) AS VARCHAR) AS request FROM r WHERE a OR t"
)
def llm_batch_requests(spark, sf):
    """The request lines for every document that lacks an author or a title."""
    return impute.llm_requests(with_flags(W.poems(spark, sf)), "any-model").select("custom_id", "row_index", "request")


_PARSED = W.LLM_LINES + """, parsed AS (SELECT line_no, CASE WHEN line_no % 33 = 11 THEN NULL ELSE line_no END AS row_index, line_no % 33 NOT IN (0, 11, 22) AS good,
 CASE WHEN line_no % 33 IN (0, 11, 22) OR line_no % 5 = 0 THEN NULL ELSE 'Author ' || line_no END AS poet, CASE WHEN line_no % 33 IN (0, 11, 22) THEN NULL WHEN line_no % 3 = 0 THEN 'untitled' ELSE 'Title ' || line_no END AS title,
 CASE WHEN line_no % 33 IN (0, 11, 22) THEN NULL ELSE CASE line_no % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END END AS confidence FROM lines)"""


@query("WITH " + _PARSED + " SELECT line_no, row_index, poet, title, confidence, CASE line_no % 33 WHEN 0 THEN 'not succeeded' WHEN 11 THEN 'bad id or line' WHEN 22 THEN 'no content' END AS error FROM parsed")
def llm_result_parse(spark, sf):
    return impute.parse_llm_results(W.llm_lines(spark, sf)).drop("value")


def applied(spark, sf):
    return impute.apply_llm_results(with_flags(W.poems(spark, sf)), impute.parse_llm_results(W.llm_lines(spark, sf)), 1)


@query("WITH " + W.POEMS + ", " + _PARSED + """ SELECT p.row_index, coalesce(CASE WHEN good AND confidence <> 'low' THEN q.poet END, p.poet) AS poet, coalesce(CASE WHEN good AND confidence <> 'low' AND q.title <> 'untitled' THEN q.title END, p.title) AS title,
 coalesce(good AND confidence <> 'low' AND q.poet IS NOT NULL, false) AS poet_imputed, coalesce(good AND confidence <> 'low' AND q.title <> 'untitled', false) AS title_imputed FROM poems p JOIN parsed q ON p.row_index = q.line_no""")
def llm_apply(spark, sf):
    return applied(spark, sf)[0].select("row_index", "poet", "title", "poet_imputed", "title_imputed")


@query("WITH " + _PARSED + """, s AS (SELECT *, good AND confidence <> 'low' AS sure FROM parsed) SELECT count(*) AS total_results, count(*) FILTER (NOT good) AS parse_errors, count(*) FILTER (good AND confidence = 'low') AS skipped_low_confidence, 0::BIGINT AS skipped_already_imputed,
 count(*) FILTER (sure AND poet IS NOT NULL) AS applied_poet, count(*) FILTER (sure AND title <> 'untitled') AS applied_title, count(*) FILTER (sure AND poet IS NOT NULL AND title <> 'untitled') AS applied_both FROM s""")
def llm_apply_stats(spark, sf):
    return applied(spark, sf)[1]


@query(
    r"WITH t AS (SELECT doc_id AS row_index, unnest(list_filter(string_split_regex(lower(text), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS term FROM documents), tf AS (SELECT row_index, term, count(*) AS n FROM t GROUP BY ALL),"
    " df AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY count(*) DESC, term LIMIT 500),"
    " w AS (SELECT row_index, term, n * idf AS w FROM tf JOIN df USING (term)) SELECT row_index, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_index)), 6) AS weight FROM w"
)
def tfidf_weights(spark, sf):
    """The unit tf-idf row of every document over the five hundred words that most documents hold."""
    p = W.poems(spark, sf).select("row_index", "text")
    vocab, idf = encoder.vocabulary(p, most=500, grams=0)
    return encoder.TextEncoder(vocab, idf, idf[:, None]).weights(p).withColumn("weight", F.round("weight", 6))


@query()
def encode_text(spark, sf):
    """Every document by the encoder that is trained on them."""
    p = W.poems(spark, sf).select("row_index", "text")
    return encoder.fit_encode(p)[1]
