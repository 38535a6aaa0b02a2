"""Queries on facts from texts and on the forms that SQL cannot express, and windowed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import extract
from brindle.sources.tables import table
from brindle.sources.trees import result_json
from brindle.streaming.events import sessions, windowed_counts


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", "repo_key", "path").join(table(spark, d, "file_texts"), "file_id")


def b11_facts(spark: SparkSession, d: str) -> DataFrame:
    """Declarations, imports, endpoints, routes and statements of every file."""
    return extract.facts(_texts(spark, d))


def b16_imports(spark: SparkSession, d: str) -> DataFrame:
    """Relative imports of scripts, resolved to files."""
    texts = _texts(spark, d)
    return extract.resolved_imports(extract.facts(texts), texts)


def b10_hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Hashed vectors of documents: number of parts that are not zero, and length."""
    vectors = extract.hash_embeddings(table(spark, d, "documents"), "doc_id", "text", 384)
    return vectors.select("doc_id", F.size(F.filter("vector", lambda x: x != 0)).alias("parts"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 3).alias("length"))


def a18_result_json(spark: SparkSession, d: str) -> DataFrame:
    """Observed files as JSON texts."""
    return result_json(table(spark, d, "source_files").select("file_id", "repo_key", "path", "size"))


def i_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"))


def i_event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"))


QUERIES = {f.__name__: f for f in (b11_facts, b16_imports, b10_hash_embeddings, a18_result_json, i_event_windows, i_event_sessions)}

ORACLES = {
    "a18_result_json": """WITH j AS (SELECT '{"file_id":' || file_id || ',"repo_key":"' || repo_key || '","path":"' || path || '","size":' || size || '}' AS json FROM source_files) SELECT json, strlen(json)::INT AS bytes FROM j""",
    "i_event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "i_event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS "end", count(*) AS n FROM s GROUP BY user_id, session""",
}
