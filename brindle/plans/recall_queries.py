"""Queries on candidate recall, with their SQL. The query set is that of ranked_chunks,
the corpus that of documents, source files and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import recall
from brindle.plans.text_queries import sql_tokens
from brindle.sources.tables import table

PARTS = ("lexical", "path_symbol", "direct_text_hits", "semantic")
NON_CODE = ["json", "xml", "css", "yaml", "markdown", "text"]


def query_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ranked_chunks").select("query_id", "query_text").distinct()


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    terms = recall.query_terms(query_set(spark, d))
    return recall.scored_postings(table(spark, d, "documents"), "doc_id", "text", terms), terms


def c1_lexical_all(spark: SparkSession, d: str) -> DataFrame:
    scored, terms = _scored(spark, d)
    return recall.lexical_all(scored, terms, "doc_id")


def c2_lexical_any(spark: SparkSession, d: str) -> DataFrame:
    scored, terms = _scored(spark, d)
    return recall.lexical_any(scored, terms, "doc_id")


def c3_path_symbol(spark: SparkSession, d: str) -> DataFrame:
    signals = table(spark, d, "code_signals").filter(F.col("deleted_at").isNull())
    symbols = signals.select(F.col("file_path").alias("path"), "name")
    tokens = signals.select(F.col("file_path").alias("path"), F.explode("tokens").alias("term")).withColumn("term", F.lower(F.trim("term"))).distinct()
    return recall.path_symbol(recall.query_terms(query_set(spark, d)), table(spark, d, "source_files"), symbols, tokens)


def c4_direct_text(spark: SparkSession, d: str) -> DataFrame:
    """Query words as literal probes in file texts with their paths."""
    probes = query_set(spark, d).select("query_id", F.explode(F.split("query_text", r"\s+")).alias("probe")).filter(F.length("probe") >= 3)
    texts = table(spark, d, "source_files").select("file_id", "path").join(table(spark, d, "file_texts"), "file_id").select("file_id", F.concat_ws("\n", "path", "content").alias("text"))
    return recall.direct_text(probes, texts, "file_id", 80)


def c6_signals(spark: SparkSession, d: str) -> DataFrame:
    return recall.signal_recall(recall.query_terms(query_set(spark, d)), table(spark, d, "code_signals"), 24)


def c8_nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Exact search: every vector whose id divides by 50, against all."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return recall.exact_vectors(vectors.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), vectors, 10)


def _variants(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each vector whose id divides by 50 as it is, and with its numbers turned round, as the
    variant of a planner; all vectors."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")
    original = asked.select("query_id", F.lit("v0").alias("variant"), F.lit("original").alias("source"), "vector")
    turned = asked.select("query_id", F.lit("v1").alias("variant"), F.lit("planner").alias("source"), F.reverse("vector").alias("vector"))
    return original.unionByName(turned), vectors


def c9_variant_recall(spark: SparkSession, d: str) -> DataFrame:
    return recall.variant_vectors(*_variants(spark, d), 10).select("query_id", "vec_id", "variant", "source", "cosine")


def c13_merged_matches(spark: SparkSession, d: str) -> DataFrame:
    merged = recall.merged_matches(recall.variant_vectors(*_variants(spark, d), 40))
    return merged.select("query_id", "vec_id", "semantic", "planner_semantic", F.array_join("variants", ",").alias("variants"))


def c10_hints(spark: SparkSession, d: str) -> DataFrame:
    """Recall of files by the two last words of each query, as hints of a planner."""
    words = F.slice(F.reverse(F.split(F.lower("query_text"), " ")), 1, 2)
    hints = query_set(spark, d).select("query_id", F.explode(words).alias("term")).distinct()
    signals = table(spark, d, "code_signals").filter(F.col("deleted_at").isNull())
    symbols = signals.select(F.col("file_path").alias("path"), "name")
    tokens = signals.select(F.col("file_path").alias("path"), F.explode("tokens").alias("term")).withColumn("term", F.lower(F.trim("term"))).distinct()
    files = table(spark, d, "source_files")
    texts = files.select("file_id", "path").join(table(spark, d, "file_texts"), "file_id").select("path", F.col("content").alias("text"))
    return recall.hint_parts(hints, texts, files, symbols, tokens)


def c11_code_scope(spark: SparkSession, d: str) -> DataFrame:
    """Files of code outside tests and third-party directories."""
    scope = recall.in_scope(table(spark, d, "source_files"), [], [r"(^|/)tests?/", r"(^|/)(vendor|node_modules|third_party)/"], [], True, NON_CODE)
    return scope.select("repo_key", "path", F.lower("language").alias("language"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ranked_chunks").select("query_id", "chunk_id", "score", F.explode("score_parts").alias("key", "value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def c12_merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    merged = recall.merge_evidence(_parts(spark, d), ["query_id", "chunk_id"])
    return merged.select("query_id", "chunk_id", F.round("score", 9).alias("score"), *[F.round(F.element_at("parts", F.lit(p)), 9).alias(p) for p in PARTS])


def c14_supported_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries one of whose terms is the token of a live signal."""
    tokens = table(spark, d, "code_signals").filter(F.col("deleted_at").isNull()).select(F.explode("tokens").alias("term")).withColumn("term", F.lower("term"))
    return recall.query_terms(query_set(spark, d)).join(tokens, "term", "left_semi").select("query_id").distinct()


QUERY_TERMS = f"queries AS (SELECT DISTINCT query_id, query_text FROM ranked_chunks), terms AS (SELECT DISTINCT query_id, lower(unnest({sql_tokens('query_text')})) AS term FROM queries)"
SCORED = f"""WITH {QUERY_TERMS},
t AS (SELECT doc_id, list_transform({sql_tokens('text')}, lambda x: lower(x)) AS tokens FROM documents),
p AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM t),
posts AS (SELECT doc_id, term, count(*) AS tf, length FROM p GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM posts)),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
scored AS (SELECT query_id, doc_id, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean))), 8) AS bm25
  FROM terms JOIN posts USING (term) JOIN df USING (term), stats)
"""

VARIANTS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, 'v0' AS variant, 'semantic' AS source, e FROM v WHERE vec_id % 50 = 0 UNION ALL SELECT vec_id, 'v1', 'planner_semantic', list_reverse(e) FROM v WHERE vec_id % 50 = 0),
near AS (SELECT query_id, vec_id, variant, source, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) AS cosine FROM q, v) """
HINTS = f"""WITH queries AS (SELECT DISTINCT query_id, query_text FROM ranked_chunks), terms AS (SELECT DISTINCT query_id, lower(unnest(string_split(query_text, ' ')[-2:])) AS term FROM queries),
t AS (SELECT path, list_transform({sql_tokens('content')}, lambda x: lower(x)) AS tokens FROM source_files JOIN file_texts USING (file_id)),
p AS (SELECT path, len(tokens) AS length, unnest(tokens) AS term FROM t), posts AS (SELECT path, term, count(*) AS tf, length FROM p GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM t WHERE len(tokens) > 0), df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
scored AS (SELECT query_id, path, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean))), 8) AS bm25 FROM terms JOIN posts USING (term) JOIN df USING (term), stats),
whole AS (SELECT query_id, path, round(sum(bm25::DECIMAL(18,8))::DOUBLE, 6) AS bm25, count(*) AS held FROM scored GROUP BY ALL), wanted AS (SELECT query_id, count(*) AS wanted FROM terms GROUP BY ALL),
every AS (SELECT query_id, path, round(1 / (1 + abs(bm25)), 8) AS value FROM whole JOIN wanted USING (query_id) WHERE held = wanted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, path) <= 80),
best AS (SELECT * FROM scored WHERE query_id NOT IN (SELECT query_id FROM every) QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY bm25 DESC, path) <= 80),
summed AS (SELECT query_id, path, round(sum(round(1 / (1 + abs(bm25)), 8)::DECIMAL(18,8))::DOUBLE, 6) AS value FROM best GROUP BY ALL),
rest AS (SELECT * FROM summed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, path) <= 80),
d AS (SELECT DISTINCT term FROM terms), live AS (SELECT * FROM code_signals WHERE deleted_at IS NULL),
hits AS (SELECT path, term, 1.0::DOUBLE AS hit FROM source_files, d WHERE contains(lower(path), term) UNION ALL SELECT file_path, term, 1.0 FROM live, d WHERE contains(lower(name), term)
  UNION ALL SELECT file_path, term, 0.25 FROM (SELECT file_path, lower(trim(unnest(tokens))) AS term FROM live) JOIN d USING (term)),
held AS (SELECT path, term, max(hit) AS hit FROM hits GROUP BY ALL), added AS (SELECT query_id, path, sum(hit) AS value FROM terms JOIN held USING (term) GROUP BY ALL), named AS (SELECT * FROM added QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, path) <= 80)
SELECT query_id, path, 'planner_lexical' AS key, value FROM every UNION ALL SELECT query_id, path, 'planner_lexical', value FROM rest UNION ALL SELECT query_id, path, 'planner_path_symbol', value FROM named"""

QUERIES = {f.__name__: f for f in (c1_lexical_all, c2_lexical_any, c3_path_symbol, c4_direct_text, c6_signals, c8_nearest_vectors, c9_variant_recall, c10_hints, c13_merged_matches, c11_code_scope, c12_merged_evidence, c14_supported_queries)}

ORACLES = {
    "c1_lexical_all": SCORED
    + """, whole AS (SELECT query_id, doc_id, round(sum(bm25::DECIMAL(18,8))::DOUBLE, 6) AS bm25, count(*) AS held FROM scored GROUP BY ALL),
wanted AS (SELECT query_id, count(*) AS wanted FROM terms GROUP BY ALL)
SELECT query_id, doc_id, round(1 / (1 + abs(bm25)), 8) AS score FROM whole JOIN wanted USING (query_id) WHERE held = wanted
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) <= 80""",
    "c2_lexical_any": SCORED
    + """, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY bm25 DESC, doc_id) <= 80),
summed AS (SELECT query_id, doc_id, round(sum(round(1 / (1 + abs(bm25)), 8)::DECIMAL(18,8))::DOUBLE, 6) AS score FROM best GROUP BY ALL)
SELECT * FROM summed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 80""",
    "c3_path_symbol": f"""WITH {QUERY_TERMS}, d AS (SELECT DISTINCT term FROM terms), live AS (SELECT * FROM code_signals WHERE deleted_at IS NULL),
hits AS (SELECT path, term, 1.0::DOUBLE AS hit FROM source_files, d WHERE contains(lower(path), term)
  UNION ALL SELECT file_path, term, 1.0 FROM live, d WHERE contains(lower(name), term)
  UNION ALL SELECT file_path, term, 0.25 FROM (SELECT file_path, lower(trim(unnest(tokens))) AS term FROM live) JOIN d USING (term)),
best AS (SELECT path, term, max(hit) AS hit FROM hits GROUP BY ALL), summed AS (SELECT query_id, path, sum(hit) AS score FROM terms JOIN best USING (term) GROUP BY ALL)
SELECT * FROM summed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) <= 80""",
    "c4_direct_text": """WITH queries AS (SELECT DISTINCT query_id, query_text FROM ranked_chunks),
words AS (SELECT query_id, unnest(regexp_split_to_array(query_text, '\\s+')) AS probe FROM queries),
probes AS (SELECT DISTINCT query_id, translate(replace(lower(probe), 'ß', 'ss'), 'ςſ', 'σs') AS probe FROM words WHERE length(probe) >= 3),
counts AS (SELECT query_id, count(*) AS probes FROM probes GROUP BY ALL),
texts AS (SELECT file_id, translate(replace(lower(concat_ws(chr(10), path, content)), 'ß', 'ss'), 'ςſ', 'σs') AS text FROM source_files JOIN file_texts USING (file_id)),
found AS (SELECT query_id, file_id, count(*) AS hits, bool_or(length(probe) >= 8 OR regexp_matches(probe, '[\\x{3400}-\\x{9fff}]{4}')) AS strong FROM probes JOIN texts ON contains(text, probe) GROUP BY ALL),
scored AS (SELECT query_id, file_id, hits, round(CASE WHEN NOT strong THEN least(0.5::DOUBLE, hits / least(probes, 6)::DOUBLE) ELSE least(1.0::DOUBLE, greatest(0.6::DOUBLE, hits / least(probes, 6)::DOUBLE)) END, 6) AS score FROM found JOIN counts USING (query_id))
SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hits DESC, file_id) <= 80""",
    "c6_signals": f"""WITH {QUERY_TERMS}, live AS (SELECT DISTINCT ON (signal_id) signal_id, kind, start_line, end_line, name,
  lower(concat_ws(' ', name, array_to_string(coalesce(tokens, []::VARCHAR[]), ' '), array_to_string(list_concat(map_keys(metadata), map_values(metadata)), ' '))) AS hay
  FROM code_signals WHERE recallable AND deleted_at IS NULL),
hits AS (SELECT query_id, signal_id, count(*) AS hits FROM terms JOIN live ON contains(hay, term) GROUP BY ALL)
SELECT query_id, signal_id, hits FROM hits JOIN live USING (signal_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, CASE WHEN kind = 'endpoint' THEN 0 ELSE 1 END, start_line, end_line, kind, name, signal_id) <= 24""",
    "c8_nearest_vectors": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) AS cosine
FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY cosine DESC, v.vec_id) <= 10""",
    "c9_variant_recall": VARIANTS + "SELECT query_id, vec_id, variant, source, cosine FROM near QUALIFY row_number() OVER (PARTITION BY query_id, variant ORDER BY cosine DESC, vec_id) <= 10",
    "c13_merged_matches": VARIANTS
    + """, best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id, variant ORDER BY cosine DESC, vec_id) <= 40)
SELECT query_id, vec_id, max(cosine) FILTER (source = 'semantic') AS semantic, max(cosine) FILTER (source = 'planner_semantic') AS planner_semantic, string_agg(variant, ',' ORDER BY -cosine, variant) AS variants FROM best GROUP BY ALL""",
    "c10_hints": HINTS,
    "c11_code_scope": "SELECT repo_key, path, lower(language) AS language FROM source_files WHERE NOT regexp_matches(path, '(^|/)tests?/') AND NOT regexp_matches(path, '(^|/)(vendor|node_modules|third_party)/') AND (language IS NULL OR lower(language) NOT IN (" + ", ".join(f"'{x}'" for x in NON_CODE) + "))",
    "c12_merged_evidence": "WITH e AS (SELECT query_id, chunk_id, score, unnest(map_entries(score_parts)) AS p FROM ranked_chunks), k AS (SELECT query_id, chunk_id, score, p.key AS key, p.value AS value FROM e WHERE p.value IS NOT NULL AND NOT isnan(p.value)) SELECT query_id, chunk_id, round(max(score), 9) AS score, " + ", ".join(f"round(max(value) FILTER (key = '{p}'), 9) AS {p}" for p in PARTS) + " FROM k GROUP BY ALL",
    "c14_supported_queries": f"WITH {QUERY_TERMS}, tokens AS (SELECT lower(unnest(tokens)) AS term FROM code_signals WHERE deleted_at IS NULL) SELECT DISTINCT query_id FROM terms WHERE term IN (SELECT term FROM tokens)",
}
