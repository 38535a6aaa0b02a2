"""Queries on ranking, selection and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import distinct_lower, identifier_tokens
from brindle.operators import evaluation, ranking
from brindle.sources.tables import table

# Words that tell nothing about a query's results.
STOP = ["the", "and", "for", "with", "from", "this", "that", "get", "set"]
REASONS = {"lexical": "text match", "path_symbol": "path or symbol match", "direct_text_hits": "literal match", "semantic": "similar meaning"}


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Distinct candidates; scores that are null or NaN count as 0."""
    rows = table(spark, d, "ranked_chunks").dropDuplicates(["query_id", "chunk_id"])
    clean = lambda c: F.when(F.col(c).isNull() | F.isnan(c), 0.0).otherwise(F.col(c))
    return rows.withColumns({"score": clean("score"), "rerank_score": clean("rerank_score")})


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_signals").filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min("file_path").alias("path"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).join(_paths(spark, d), "chunk_id", "left")
    clamped = ranking.ceiling_clamped(rows, "query_id")
    keys = [F.desc(F.round("final_score", 3)), "evidence_priority", "clamped", F.desc("final_score"), F.desc("score"), "path", "start_line", "chunk_id"]
    return ranking.ordered(clamped, "query_id", keys)


def f3_combined(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("query_id", "chunk_id", F.round(ranking.combined_score(), 6).alias("combined"))


def f4_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("query_id", "chunk_id", F.round(ranking.max_normalised(F.col("rerank_score"), "query_id"), 6).alias("share"))


def f8_clamped(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.ceiling_clamped(_candidates(spark, d), "query_id")
    return rows.select("query_id", "chunk_id", "clamped", F.round("final_score", 6).alias("final_score"))


def f9_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates outside the project unit of the best candidate of their query."""
    units = table(spark, d, "code_signals").filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min("project_unit_key").alias("unit"))
    rows = _candidates(spark, d).join(units, "chunk_id")
    best = rows.groupBy("query_id").agg(F.max(F.struct("rerank_score", "chunk_id", "unit"))["unit"].alias("best_unit"), F.count_distinct("unit").alias("units"))
    penalty = F.when((F.col("units") > 1) & (F.col("unit") != F.col("best_unit")), -0.05).otherwise(0.0)
    return rows.join(best, "query_id").select("query_id", "chunk_id", penalty.alias("penalty"))


def f10_order(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("query_id", "chunk_id", "position")


def f1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of the query's tokens among the tokens of the chunk's signals."""
    tokens = table(spark, d, "code_signals").filter(F.col("chunk_id").isNotNull()).select("chunk_id", F.explode("tokens").alias("t")).groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.lower("t"))).alias("tokens"))
    rows = _candidates(spark, d).select("query_id", "chunk_id", distinct_lower(identifier_tokens(F.col("query_text"))).alias("wanted"))
    return rows.join(tokens, "chunk_id").select("query_id", "chunk_id", F.round(ranking.token_coverage(F.col("wanted"), F.col("tokens")), 6).alias("coverage"))


def f25_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("query_id", "chunk_id", F.array_join(ranking.reasons(REASONS), "; ").alias("reasons"))


def f26_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Candidates per tier and evidence class of each query."""
    return _candidates(spark, d).groupBy("query_id", "rank_tier", "evidence_class").agg(F.count("*").alias("candidates"), F.round(F.max("rerank_score"), 6).alias("best"))


def f27_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines shown around each live signal."""
    files = table(spark, d, "source_files").select("file_id", "path").join(table(spark, d, "file_texts"), "file_id")
    lines = files.select("file_id", F.col("path").alias("file_path"), (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    spans = table(spark, d, "code_signals").filter(F.col("deleted_at").isNull()).select("signal_id", "file_path", "start_line", "end_line").distinct()
    return spans.join(lines, "file_path").select("file_id", "signal_id", ranking.context_window(F.col("start_line"), F.col("end_line"), F.col("lines").cast("int")).alias("w")).select("file_id", "signal_id", "w.start_line", "w.end_line")


def f28_merged_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of live signals of a file, overlapping ones as one."""
    spans = table(spark, d, "code_signals").filter(F.col("deleted_at").isNull()).select("file_path", "start_line", "end_line").distinct()
    return ranking.islands(spans, ["file_path"])


def f30_selected(spark: SparkSession, d: str) -> DataFrame:
    """Twelve results per query, one per path."""
    rows = _ranked(spark, d).filter(F.col("path").isNotNull())
    return ranking.first_per_path(rows, "query_id", "path", 12).select("query_id", "path", "chunk_id", "position")


def f33_follow_ups(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "code_signals").filter(F.col("chunk_id").isNotNull() & F.col("tokens").isNotNull()).select("chunk_id", "tokens")
    rows = _candidates(spark, d).select("query_id", "chunk_id").join(tokens, "chunk_id")
    return ranking.follow_up_terms(rows, "query_id", "tokens", STOP).select("query_id", "term", "n", "position")


def _plain_cases(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the order by plain score."""
    rows = ranking.ordered(_candidates(spark, d), "query_id", [F.desc("score"), "chunk_id"])
    judged = rows.select("query_id", "position", (F.col("evidence_class") == "original_direct").alias("relevant"), (F.col("evidence_class") == "weak_or_generic").alias("noise"))
    return evaluation.case_metrics(judged, "query_id")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d)
    judged = rows.select("query_id", "position", (F.col("evidence_class") == "original_direct").alias("relevant"), (F.col("evidence_class") == "weak_or_generic").alias("noise"))
    return evaluation.case_metrics(judged, "query_id")


def h4_case_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d)


def h9_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Metrics overall, by number of words and first word of the query, and by its words as
    tags; the measure is the length of the query."""
    texts = table(spark, d, "ranked_chunks").select("query_id", "query_text").distinct()
    cases = _cases(spark, d).join(texts, "query_id").select("hit_10", "reciprocal_rank", F.length("query_text").alias("query_length"), F.size(F.split("query_text", " ")).alias("words"), F.substring_index("query_text", " ", 1).alias("first"), F.split("query_text", " ").alias("tags"))
    return evaluation.grouped_metrics(cases, ["words", "first"], "query_length", "tags")


def h11_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The order by plain score against the final order."""
    return evaluation.compare_reports(_plain_cases(spark, d), _cases(spark, d), "query_id")


def h13_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and day: number, extremes and mean of the value, users."""
    events = table(spark, d, "events")
    return events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"), F.expr("sum(cast(round(value * 100) as bigint)) div count(value)").alias("mean_cents"), F.count_distinct("user_id").alias("users"))


def h16_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Absolute paths of files as a report may show them."""
    return table(spark, d, "source_files").select("file_id", evaluation.redacted(F.concat(F.lit("cannot read "), "absolute_path", F.lit(": token=abc123"))).alias("message"))


# --- SQL ---------------------------------------------------------------------------
CAND = """cand AS (SELECT DISTINCT ON (query_id, chunk_id) * REPLACE (CASE WHEN score IS NULL OR isnan(score) THEN 0.0::DOUBLE ELSE score END AS score, CASE WHEN rerank_score IS NULL OR isnan(rerank_score) THEN 0.0::DOUBLE ELSE rerank_score END AS rerank_score) FROM ranked_chunks),
parts AS (SELECT *, """ + ", ".join(f"CASE WHEN score_parts['{p}'] IS NULL OR isnan(score_parts['{p}']) THEN 0.0::DOUBLE ELSE score_parts['{p}'] END AS {p}" for p in ("lexical", "path_symbol", "direct_text_hits", "semantic")) + " FROM cand)"
PATHS = "paths AS (SELECT chunk_id, min(file_path) AS path, min(start_line) AS start_line, max(end_line) AS end_line FROM code_signals WHERE chunk_id IS NOT NULL GROUP BY ALL)"
CLAMP = "ceil AS (SELECT *, min(rerank_score) FILTER (evidence_priority = 0) OVER (PARTITION BY query_id) * (1 - 1e-6::DOUBLE) AS ceiling FROM parts), clamped AS (SELECT *, coalesce(evidence_priority > 0 AND ceiling IS NOT NULL AND rerank_score > ceiling, false) AS clamped FROM ceil), final AS (SELECT *, CASE WHEN clamped THEN ceiling ELSE rerank_score END AS final_score FROM clamped)"
RANKED = f"WITH {CAND}, {CLAMP}, {PATHS}, ranked AS (SELECT f.*, p.path, p.start_line, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 3) DESC, evidence_priority, clamped, final_score DESC, score DESC, path NULLS FIRST, start_line NULLS FIRST, chunk_id)::INT AS position FROM final f LEFT JOIN paths p USING (chunk_id))"
SELECTED = RANKED + ", firsts AS (SELECT query_id, path, min(position) AS position FROM ranked WHERE path IS NOT NULL GROUP BY ALL), chosen AS (SELECT r.* REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY position)::INT AS position) FROM ranked r JOIN firsts USING (query_id, path, position)), selected AS (SELECT * FROM chosen WHERE position <= 12)"
METRICS = "min(position) FILTER (relevant) AS first_rank, round(coalesce(1.0::DOUBLE / min(position) FILTER (relevant), 0), 6) AS reciprocal_rank, " + ", ".join(f"coalesce(min(position) FILTER (relevant) <= {k}, false) AS hit_{k}" for k in (1, 3, 5, 10)) + ", " + ", ".join(f"round(CASE WHEN count(*) FILTER (relevant) > 0 THEN count(*) FILTER (relevant AND position <= {k}) / (count(*) FILTER (relevant))::DOUBLE ELSE 0.0 END, 6) AS recall_{k}" for k in (5, 10)) + ", round(count(*) FILTER (relevant AND position <= 5) / 5.0::DOUBLE, 6) AS precision_5, " + ", ".join(f"count(*) FILTER (noise AND position <= {k}) AS noise_{k}" for k in (5, 10))
CASES = RANKED + f", judged AS (SELECT query_id, position, evidence_class = 'original_direct' AS relevant, evidence_class = 'weak_or_generic' AS noise FROM ranked), cases AS (SELECT query_id, {METRICS} FROM judged GROUP BY query_id)"

from brindle.plans.text_queries import sql_tokens  # noqa: E402

QUERIES = {
    f.__name__: f
    for f in (
        f1_coverage, f3_combined, f4_normalised, f8_clamped, f9_cohorts, f10_order, f25_reasons, f26_tiers, f27_context, f28_merged_spans, f30_selected, f33_follow_ups,
        h4_case_metrics, h9_grouped, h11_comparison, h13_feedback, h16_redacted,
    )
}

ORACLES = {
    "f1_coverage": f"WITH {CAND}, t AS (SELECT chunk_id, list_distinct(list(lower(t))) AS tokens FROM (SELECT chunk_id, unnest(tokens) AS t FROM code_signals WHERE chunk_id IS NOT NULL) WHERE t IS NOT NULL GROUP BY ALL), q AS (SELECT query_id, chunk_id, list_distinct(list_transform({sql_tokens('query_text')}, lambda x: lower(x))) AS wanted FROM cand) SELECT query_id, chunk_id, round(CASE WHEN len(wanted) > 0 THEN len(list_filter(wanted, lambda x: list_contains(tokens, x))) / len(wanted)::DOUBLE ELSE 0 END, 6) AS coverage FROM q JOIN t USING (chunk_id)",
    "f3_combined": f"WITH {CAND} SELECT query_id, chunk_id, round(greatest(semantic, 0.0::DOUBLE) * 0.55::DOUBLE + least(path_symbol, 5.0::DOUBLE) / 5 * 0.15::DOUBLE + lexical * 0.25::DOUBLE, 6) AS combined FROM parts",
    "f4_normalised": f"WITH {CAND}, k AS (SELECT query_id, chunk_id, CASE WHEN isinf(rerank_score) THEN 0 ELSE rerank_score END AS v FROM cand) SELECT query_id, chunk_id, round(CASE WHEN max(v) OVER w <= 0 THEN 0.0::DOUBLE ELSE greatest(v, 0.0::DOUBLE) / max(v) OVER w END, 6) AS share FROM k WINDOW w AS (PARTITION BY query_id)",
    "f8_clamped": f"WITH {CAND}, {CLAMP} SELECT query_id, chunk_id, clamped, round(final_score, 6) AS final_score FROM final",
    "f9_cohorts": f"WITH {CAND}, u AS (SELECT chunk_id, min(project_unit_key) AS unit FROM code_signals WHERE chunk_id IS NOT NULL GROUP BY ALL), r AS (SELECT cand.*, unit FROM cand JOIN u USING (chunk_id)), b AS (SELECT query_id, max((rerank_score, chunk_id, unit))[3] AS best_unit, count(DISTINCT unit) AS units FROM r GROUP BY ALL) SELECT query_id, chunk_id, CASE WHEN units > 1 AND unit <> best_unit THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM r JOIN b USING (query_id)",
    "f10_order": RANKED + " SELECT query_id, chunk_id, position FROM ranked",
    "f25_reasons": f"WITH {CAND} SELECT query_id, chunk_id, concat_ws('; ', " + ", ".join(f"CASE WHEN {k} > 0 THEN '{v}' END" for k, v in REASONS.items()) + ") AS reasons FROM parts",
    "f26_tiers": f"WITH {CAND} SELECT query_id, rank_tier, evidence_class, count(*) AS candidates, round(max(rerank_score), 6) AS best FROM cand GROUP BY ALL",
    "f27_context": "WITH f AS (SELECT path, file_id FROM source_files), l AS (SELECT file_id, path AS file_path, length(content) - length(replace(content, chr(10), '')) + 1 AS lines FROM f JOIN file_texts USING (file_id)), s AS (SELECT DISTINCT signal_id, file_path, start_line, end_line FROM code_signals WHERE deleted_at IS NULL) SELECT file_id, signal_id, greatest(1, start_line - 8)::INT AS start_line, least(lines, end_line + 12)::INT AS end_line FROM s JOIN l USING (file_path)",
    "f28_merged_spans": "WITH s AS (SELECT DISTINCT file_path, start_line, end_line FROM code_signals WHERE deleted_at IS NULL), r AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM r) SELECT file_path, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS merged FROM g GROUP BY file_path, island",
    "f30_selected": SELECTED + " SELECT query_id, path, chunk_id, position FROM selected",
    "f33_follow_ups": f"WITH {CAND}, t AS (SELECT c.query_id, lower(unnest(s.tokens)) AS term FROM cand c JOIN code_signals s USING (chunk_id)), n AS (SELECT query_id, term, count(*) AS n FROM t WHERE length(term) >= 3 AND term NOT IN (" + ", ".join(f"'{s}'" for s in STOP) + ") AND NOT regexp_full_match(term, '[0-9]+') GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term)::INT AS position FROM n QUALIFY position <= 12",
    "h4_case_metrics": CASES + " SELECT * FROM cases",
    "h9_grouped": CASES + """, q AS (SELECT DISTINCT query_id, query_text FROM ranked_chunks), c AS (SELECT hit_10, reciprocal_rank, length(query_text)::INT AS query_length, len(string_split(query_text, ' '))::VARCHAR AS words, string_split(query_text, ' ')[1] AS first, list_distinct(string_split(query_text, ' ')) AS tags FROM cases JOIN q USING (query_id)),
s AS (SELECT 'overall' AS grouping, 'all' AS value, * FROM c UNION ALL SELECT 'words', words, * FROM c UNION ALL SELECT 'first', first, * FROM c UNION ALL SELECT 'tag', unnest(tags), * FROM c)
SELECT grouping, value, count(*) AS cases, count(*) FILTER (hit_10) AS hits, round(count(*) FILTER (hit_10) / count(*)::DOUBLE, 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, quantile_disc(query_length, 0.5) AS query_length_p50, quantile_disc(query_length, 0.95) AS query_length_p95 FROM s GROUP BY grouping, value""",
    "h11_comparison": CASES + f""", plain AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position, evidence_class = 'original_direct' AS relevant, evidence_class = 'weak_or_generic' AS noise FROM cand), before AS (SELECT query_id, {METRICS} FROM plain GROUP BY query_id)
SELECT query_id, CASE WHEN a.reciprocal_rank IS NULL THEN 'added' WHEN b.reciprocal_rank IS NULL THEN 'removed' WHEN round(b.reciprocal_rank - a.reciprocal_rank, 6) < -0.25 OR (a.hit_5 AND NOT b.hit_5) OR b.noise_5 - a.noise_5 >= 2 THEN 'regressed' WHEN round(b.reciprocal_rank - a.reciprocal_rank, 6) > 1e-12 OR (b.hit_5 AND NOT a.hit_5) THEN 'improved' ELSE 'same' END AS status, round(b.reciprocal_rank - a.reciprocal_rank, 6) AS rank_delta FROM before a FULL JOIN cases b USING (query_id)""",
    "h13_feedback": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(min(value), 4) AS least, round(max(value), 4) AS most, (sum(round(value * 100)::BIGINT)::BIGINT // count(value)) AS mean_cents, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
    "h16_redacted": r"SELECT file_id, regexp_replace(regexp_replace('cannot read ' || absolute_path || ': token=abc123', '(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)\S+', '\1\2[redacted]', 'g'), '/(home|Users|root|srv)/[^\s:''\x22]+', '[path]', 'g') AS message FROM source_files",
}
