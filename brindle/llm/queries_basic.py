"""Queries on term weights and rank fusion, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.fusion import PARTS, RRF_K, fused_ranking, leading
from brindle.llm.terms import shared_terms, term_counts, term_weights, top_terms
from brindle.sources.tables import table


def p1_weights(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every live signal with its weight."""
    return term_weights(table(spark, d, "code_signals")).withColumn("weight", F.round("weight", 4))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that few signals share. Every term has a weight (``p1_weights``), so none is computed here."""
    cells = term_counts(table(spark, d, "code_signals"))
    return cells.join(shared_terms(cells, 2, 12), "term").select("signal_id", "term")


def p1_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten most characteristic terms of every live signal."""
    return top_terms(term_weights(table(spark, d, "code_signals")), 10)


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fused_ranking(table(spark, d, "ranked_chunks")).withColumn("fused", F.round("fused", 9))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leading(fused_ranking(table(spark, d, "ranked_chunks"))).select("query_id", "chunk_id")


P1_CELLS = r"""
WITH live AS (SELECT DISTINCT signal_id, name, tokens FROM code_signals WHERE deleted_at IS NULL AND signal_id IS NOT NULL),
cut AS (
  SELECT signal_id, tokens,
    regexp_replace(regexp_replace(nfc_normalize(name), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g') AS spaced
  FROM live),
words AS (
  SELECT signal_id, unnest(tokens) AS t FROM cut
  UNION ALL SELECT signal_id, unnest(regexp_extract_all(spaced, '[\p{L}\p{M}]+|\p{Nd}+')) FROM cut),
terms AS (
  SELECT signal_id, lower(regexp_replace(nfc_normalize(t), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS term FROM words WHERE t IS NOT NULL),
cells AS (SELECT signal_id, term, count(*) AS n FROM terms WHERE term <> '' GROUP BY ALL),
cols AS (SELECT term, sum(n)::BIGINT AS column_n, count(*) AS records FROM cells GROUP BY term),
"""

P1_WEIGHTS = (
    P1_CELLS
    + """sized AS (SELECT signal_id, sum(n)::BIGINT AS row_n FROM cells GROUP BY signal_id),
total AS (SELECT sum(n)::BIGINT AS total_n FROM cells),
e AS (SELECT c.*, records, row_n * column_n / total_n::DOUBLE AS e, (1 - row_n / total_n::DOUBLE) * (1 - column_n / total_n::DOUBLE) AS v
  FROM cells c JOIN cols USING (term) JOIN sized USING (signal_id), total),
weights AS (SELECT signal_id, term, n, records, CASE WHEN e * v > 0 THEN (n - e) / sqrt(e * v) ELSE 0.0 END AS weight FROM e)
"""
)

P3_RANKED = f"""
WITH parts AS (
  SELECT query_id, chunk_id, score, rerank_score, {", ".join(f"score_parts['{p}'] AS {p}" for p in PARTS)} FROM ranked_chunks),
distinct_c AS (
  SELECT query_id, chunk_id, {", ".join(f"max(CASE WHEN NOT isnan({c}) THEN {c} END) AS {c}" for c in ("score", "rerank_score", *PARTS))}
  FROM parts GROUP BY ALL),
ranks AS (
  SELECT query_id, chunk_id, {", ".join(f"rank() OVER (PARTITION BY query_id ORDER BY {c} DESC NULLS LAST) AS rank_{c}" for c in ("score", "rerank_score", *PARTS))}
  FROM distinct_c),
fused AS (SELECT *, round({" + ".join(f"1.0::DOUBLE / ({RRF_K} + rank_{c})" for c in ("score", "rerank_score", *PARTS))}, 12) AS fused FROM ranks)
"""

QUERIES = {"p1_found": p1_found, "p1_weights": p1_weights, "p1_top": p1_top, "p3_found": p3_found, "p3_ranking": p3_ranking}

ORACLES = {
    "p1_found": P1_CELLS + "kept AS (SELECT term FROM cols WHERE records BETWEEN 2 AND 12) SELECT c.signal_id, c.term FROM cells c JOIN kept USING (term)",
    "p1_weights": P1_WEIGHTS + "SELECT signal_id, term, n, records, round(weight, 4) AS weight FROM weights",
    "p1_top": P1_WEIGHTS
    + """, ranked AS (SELECT signal_id, term, weight, row_number() OVER (PARTITION BY signal_id ORDER BY round(weight, 6) DESC, term) AS position FROM weights)
SELECT signal_id, term, round(weight, 4) AS weight, position::INT AS position FROM ranked WHERE position <= 10""",
    "p3_found": P3_RANKED + "SELECT query_id, chunk_id FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) <= 5",
    "p3_ranking": P3_RANKED + f"SELECT query_id, chunk_id, {', '.join(f'rank_{c}' for c in ('score', 'rerank_score', *PARTS))}, round(fused, 9) AS fused FROM fused",
}
