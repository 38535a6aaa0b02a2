"""Queries on incremental processing and on broken references, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.incremental import IntervalLedger, replay_ledger, replay_runs
from brindle.operators.orphans import OrphanLedger, orphan_counts, orphan_references, replay_orphans
from brindle.session import shared_folder
from brindle.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return replay_runs(table(spark, d, "source_observations"), table(spark, d, "index_runs")).select("run_id", "path").distinct()


def p5_run_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files to process per run."""
    return replay_runs(table(spark, d, "source_observations"), table(spark, d, "index_runs")).groupBy("run_id").agg(F.count("*").alias("files"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "code_relations"), table(spark, d, "code_signals"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("relation_id", "side").distinct()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month of recorded_at."""
    return orphan_counts(_orphans(spark, d))


def _ledger_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def p5_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The cases of p5_found from the ledger on disk, run by run."""
    ledger = IntervalLedger(spark, _ledger_folder(spark, "intervals"), buckets=8)
    return replay_ledger(ledger, table(spark, d, "source_observations"), table(spark, d, "index_runs")).select("run_id", "path").distinct()


def p6_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The cases of p6_found from the ledger on disk, one batch per month."""
    ledger = OrphanLedger(spark, _ledger_folder(spark, "orphans"), buckets=8)
    return replay_orphans(ledger, table(spark, d, "code_relations"), table(spark, d, "code_signals")).select("relation_id", "side").distinct()


P5_CASES = """
WITH runs AS (SELECT run_id, repo_key, started_at FROM index_runs WHERE status = 'succeeded' AND started_at IS NOT NULL),
known AS (
  SELECT r.run_id, r.repo_key, r.started_at, o.path, lower(o.sha256) AS state, o.observation_generation AS gen
  FROM source_observations o JOIN runs r ON r.repo_key = o.repo_key AND o.received_at <= r.started_at
  WHERE o.path IS NOT NULL AND o.observation_generation IS NOT NULL),
states AS (SELECT run_id, repo_key, started_at, path, arg_max(state, gen) AS state FROM known GROUP BY ALL),
moved AS (
  SELECT run_id, path, state, lag(state) OVER w AS last, row_number() OVER w AS n
  FROM states WINDOW w AS (PARTITION BY repo_key, path ORDER BY started_at, run_id)),
cases AS (SELECT DISTINCT run_id, path FROM moved WHERE n = 1 OR state IS DISTINCT FROM last)
"""

P6_CASES = r"""
WITH parents AS (SELECT signal_id, min(recorded_at) AS first_seen FROM code_signals WHERE deleted_at IS NULL GROUP BY signal_id),
refs AS (
  SELECT relation_id, 'source' AS side, source_signal_id AS ref_id, recorded_at FROM code_relations WHERE deleted_at IS NULL
  UNION ALL
  SELECT relation_id, 'target', target_signal_id, recorded_at FROM code_relations
  WHERE deleted_at IS NULL AND resolution IN ('resolved_exact', 'resolved_unique')),
probed AS (
  SELECT r.relation_id, r.side, r.recorded_at, p.first_seen, coalesce(trim(r.ref_id, ' ' || chr(9) || chr(10) || chr(13)), '') = '' AS blank
  FROM refs r LEFT JOIN parents p ON p.signal_id = r.ref_id),
orphans AS (
  SELECT relation_id, side, min(recorded_at) AS recorded_at, bool_or(blank) AS blank, max(CASE WHEN NOT blank THEN first_seen END) AS resolved_at
  FROM probed WHERE blank OR first_seen IS NULL OR first_seen > recorded_at GROUP BY ALL)
"""

QUERIES = {"p5_found": p5_found, "p5_run_totals": p5_run_totals, "p5_ledger": p5_ledger, "p6_found": p6_found, "p6_counts": p6_counts, "p6_ledger": p6_ledger}

ORACLES = {
    "p5_found": P5_CASES + "SELECT run_id, path FROM cases",
    "p5_run_totals": P5_CASES + "SELECT run_id, count(*) AS files FROM cases GROUP BY run_id",
    "p5_ledger": P5_CASES + "SELECT run_id, path FROM cases",
    "p6_ledger": P6_CASES + "SELECT relation_id, side FROM orphans",
    "p6_found": P6_CASES + "SELECT relation_id, side FROM orphans",
    "p6_counts": P6_CASES
    + """SELECT 'code_relations.' || side AS table_name, strftime(date_trunc('month', recorded_at), '%Y-%m-%d') AS period,
  count(*) AS orphans, count(*) FILTER (blank) AS blank, count(*) FILTER (resolved_at IS NOT NULL) AS resolved_later,
  count(*) FILTER (resolved_at IS NULL) AS still_open FROM orphans GROUP BY ALL""",
}
