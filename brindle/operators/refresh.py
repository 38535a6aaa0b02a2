"""Snapshots, differences between them, and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["repo_key", "path"]


def latest_snapshot(observations: DataFrame, generation: Column | None = None) -> DataFrame:
    """The newest observation of every file, of equal generations the one received last."""
    rows = observations if generation is None else observations.filter(F.col("observation_generation") <= generation)
    newest = F.max(F.struct("observation_generation", "received_at", F.lower("sha256").alias("sha256"), "size", "mtime_ns", "change_token")).alias("n")
    return rows.groupBy(*KEY).agg(newest).select(*KEY, "n.*")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``added``, ``deleted``, ``changed``, ``touched`` (only times differ) or ``unchanged`` per
    file. Both have ``repo_key, path, sha256, mtime_ns``; a null digest is a content of its
    own, so a file without one is neither new nor gone."""
    a = before.select(*KEY, F.lower("sha256").alias("a_sha"), F.col("mtime_ns").alias("a_time"), F.lit(True).alias("in_a"))
    b = after.select(*KEY, F.lower("sha256").alias("b_sha"), F.col("mtime_ns").alias("b_time"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(~F.col("a_sha").eqNullSafe(F.col("b_sha")), "changed").when(~F.col("a_time").eqNullSafe(F.col("b_time")), "touched").otherwise("unchanged")
    return a.join(b, KEY, "full_outer").select(*KEY, state.alias("state"))


def dependents(diff: DataFrame, relations: DataFrame, signals: DataFrame) -> DataFrame:
    """Files that import or use signals of added, changed or deleted paths and so have to be
    processed again: ``source_path, reasons``."""
    moved = diff.filter(F.col("state").isin("added", "changed", "deleted")).select(F.col("path").alias("file_path")).distinct()
    ids = signals.select("signal_id", "file_path").distinct().join(moved, "file_path", "left_semi").select(F.col("signal_id").alias("target_signal_id")).distinct()
    live = relations.filter(F.col("deleted_at").isNull()).select(F.col("source_file_path").alias("source_path"), "target_signal_id", "relation_id").distinct()
    return live.join(ids, "target_signal_id", "left_semi").groupBy("source_path").agg(F.count("*").alias("reasons"))


def retry_order(skips: DataFrame, most: int) -> DataFrame:
    """Skipped files worth another try: never tried first, then longest ago."""
    order = [F.coalesce("last_retry_generation", F.lit(-1)), "first_observation_generation", "repo_key", "path"]
    return skips.filter("retryable").orderBy(*order).limit(most)


def health(row: DataFrame) -> DataFrame:
    """The first state that holds: missing, incompatible, corrupt (only while no writer is
    at work), stale, degraded, healthy_verified, healthy_metadata."""
    state = (
        F.when(~F.col("available"), "missing")
        .when(~F.col("compatible"), "incompatible")
        .when(F.col("corrupt") & F.col("writer_idle"), "corrupt")
        .when(F.col("stale"), "stale")
        .when(F.col("degraded"), "degraded")
        .when(F.col("verified"), "healthy_verified")
        .otherwise("healthy_metadata")
    )
    return row.withColumn("health", state)


def upserted(base: DataFrame, changes: DataFrame, removed: DataFrame, key: list[str], gone_key: str) -> DataFrame:
    """A new generation: rows of ``base`` that no change of their ``key`` replaces, and the
    changes; of both without those whose ``gone_key`` is removed. Null keys match nothing."""
    kept = base.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes)
    return kept.join(removed.select(gone_key).distinct(), gone_key, "left_anti")


def purgeable(rows: DataFrame, share: float = 0.05, most: int = 5000) -> DataFrame:
    """Whether tombstones are due to be purged: beyond a share of the rows or a number."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("deleted_at").isNotNull()).alias("tombstones")).withColumn("purge", (F.col("tombstones") > F.col("total") * share) | (F.col("tombstones") > most))


def purged(rows: DataFrame, key: str, share: float = 0.05, most: int = 5000, batch: int = 5000) -> DataFrame:
    """``rows`` without their ``batch`` oldest tombstones, if a purge is due; else as they
    are. The batch bounds what one purge removes; the next takes the rest."""
    due = purgeable(rows, share, most).select("purge")
    dead = rows.filter(F.col("deleted_at").isNotNull()).crossJoin(F.broadcast(due)).filter("purge")  # one row
    oldest = dead.select(key, "deleted_at").distinct().orderBy("deleted_at", key).limit(batch)
    return rows.join(oldest, [key, "deleted_at"], "left_anti")
