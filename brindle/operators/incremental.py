"""Processing only new or changed records.

The sequence number of an observation is its ``observation_generation`` in the log
of its file (``repo_key, path``). What has been processed of a file is kept as
disjoint intervals of sequence numbers. A run subtracts them from the available
ranges, processes the gaps (which is where late rows turn up, below the highest
number seen), and commits the merged intervals together with its output.

``replay_runs`` does this for the whole run history in one plan;
``IntervalLedger`` does it run by run with a state on disk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions.intervals import (
    INTERVALS,
    empty_intervals,
    in_intervals,
    merge_intervals,
    points_to_intervals,
    subtract_intervals,
)
from brindle.session import cut_lineage
from brindle.sources.commits import CommitLog, KeyedTable

KEY = ["repo_key", "path"]


def content_state() -> Column:
    """The state of a file version: its digest, letter case ignored."""
    return F.lower(F.col("sha256"))


def replay_runs(observations: DataFrame, runs: DataFrame) -> DataFrame:
    """For every succeeded run the files that are new or changed since the last one.

    Returns ``run_id, repo_key, path, sha256, observation_generation, gap`` where
    ``gap`` holds the intervals of sequence numbers the run processed for the file.
    Runs with another status process nothing; what they saw is left to the next
    succeeded run. Succeeded runs at the same instant go by ``run_id``.

    Rows with a null in ``repo_key, path, observation_generation, received_at`` can
    belong to no file, number or run and are left out; a null ``sha256`` is a state
    of its own. Two digests under one number: the greater one counts. Repeated rows
    change nothing; empty tables give no rows.

    Only rows of one file meet in one task, after they have been merged to at most
    one row per run; the run table is one array per repository, so a repository
    with a third of all rows is split freely (its rows are joined, not grouped).
    """
    timeline = (
        runs.filter((F.col("status") == "succeeded") & F.col("started_at").isNotNull() & F.col("run_id").isNotNull())
        .groupBy("repo_key")
        .agg(F.array_sort(F.collect_list(F.struct("started_at", "run_id"))).alias("timeline"))
    )
    known = (
        observations.select(*KEY, "observation_generation", "received_at", content_state().alias("state"))
        .dropna(subset=["repo_key", "path", "observation_generation", "received_at"])
        .join(timeline, "repo_key")
        # the first run that started when the row was there
        .withColumn("at", F.size(F.filter("timeline", lambda t: t["started_at"] < F.col("received_at"))))
        .filter(F.col("at") < F.size("timeline"))
        .withColumn("run", F.element_at("timeline", F.col("at") + 1))
    )
    arrived = known.groupBy(*KEY, "run").agg(
        F.max(F.struct("observation_generation", "state")).alias("best"),
        points_to_intervals(F.collect_set("observation_generation")).alias("available"),
    )
    order = Window.partitionBy(*KEY).orderBy("run")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    gaps = (
        arrived.withColumn("processed", merge_intervals(F.flatten(F.collect_list("available").over(before))))
        .withColumn("gap", subtract_intervals(F.col("available"), F.col("processed")))
        .filter(F.size("gap") > 0)
        .withColumn("now", F.max("best").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("last", F.max("best").over(before))
    )
    # Between two cases the state is that of the earlier case, so the state at the
    # run before is the state of the latest case.
    changed = gaps.filter(F.col("last").isNull() | ~F.col("now.state").eqNullSafe(F.col("last.state")))
    return changed.select(
        F.col("run.run_id").alias("run_id"),
        *KEY,
        F.col("now.state").alias("sha256"),
        F.col("now.observation_generation").alias("observation_generation"),
        "gap",
    )


STATE = f"repo_key string, path string, processed {INTERVALS}, observation_generation bigint, state string"
OUTPUT = f"run_id bigint, repo_key string, path string, sha256 string, observation_generation bigint, gap {INTERVALS}"


class IntervalLedger:
    """Run-by-run processing with state on a shared file system.

    A version of the log names the state (per file: intervals processed, highest number,
    its state; in hash buckets of which a run rewrites only those it touches) and the
    output of its run. Both are committed by one file: a run that dies earlier leaves
    nothing that a later run reads, and a run that loses the race against another writer
    is computed again over that writer's state, so rows are neither skipped nor repeated.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.log = spark, CommitLog(spark, folder)
        self._state = KeyedTable(self.log, "state", STATE, KEY, buckets)

    def version(self) -> int:
        """The last committed version, 0 before the first run."""
        return self.log.version()

    def state(self) -> DataFrame:
        return self._state.read(self.log.read(self.log.version()))

    def output(self, version: int) -> DataFrame:
        return self.spark.read.schema(OUTPUT).parquet(f"{self.log.folder}/{self.log.read(version)['output']}")

    def outputs(self) -> DataFrame:
        """The output of all runs."""
        paths = [f"{self.log.folder}/{self.log.read(v)['output']}" for v in range(1, self.log.version() + 1)]
        return self.spark.read.schema(OUTPUT).parquet(*paths) if paths else self.spark.createDataFrame([], OUTPUT)

    def run(self, observations: DataFrame, run_id: int, repo_key: str, started_at, before_commit: Callable[[], None] | None = None) -> DataFrame:
        """Process what is new for ``repo_key`` at ``started_at``; returns the files to process."""
        return self.step(observations, self.spark.createDataFrame([(run_id, repo_key, started_at)], "run_id bigint, repo_key string, started_at timestamp"), before_commit)

    def step(self, observations: DataFrame, runs: DataFrame, before_commit: Callable[[], None] | None = None) -> DataFrame:
        """Process one run (``run_id, started_at``) of each ``repo_key`` in ``runs`` and commit
        them together; returns the files to process. ``before_commit`` is called between
        writing and committing."""
        asked = runs.select("run_id", "repo_key", "started_at")
        rows = (
            observations.select(*KEY, "observation_generation", "received_at", content_state().alias("state"))
            .dropna(subset=[*KEY, "observation_generation"])
            .join(asked, "repo_key")
            .filter(F.col("received_at") <= F.col("started_at"))
            .select("run_id", *KEY, "observation_generation", "state")
            .distinct()
        )

        def work(version: int, content: dict) -> dict:
            # Rows of numbers that are already processed fall out before they are grouped.
            processed = self._state.read(content).join(asked.select("repo_key"), "repo_key", "left_semi").select(*KEY, "processed")
            fresh = rows.join(processed, KEY, "left").filter(~in_intervals(F.col("observation_generation"), F.col("processed")))
            gaps = cut_lineage(
                fresh.groupBy("run_id", *KEY).agg(
                    F.max(F.struct("observation_generation", "state")).alias("best"),
                    points_to_intervals(F.collect_set("observation_generation")).alias("gap"),
                )
            )
            touched = self._state.touched(gaps)
            old = self._state.read(content, touched).withColumnsRenamed({"observation_generation": "old_generation", "state": "old_state"})
            had = F.col("processed").isNotNull()
            newer = ~had | (F.col("best.observation_generation") > F.col("old_generation"))
            merged = (
                old.join(gaps, KEY, "full_outer")
                .withColumn("moved", F.col("gap").isNotNull() & newer)
                .withColumn("changed", F.col("moved") & (~had | ~F.col("best.state").eqNullSafe(F.col("old_state"))))
            )
            home = self.log.new_folder()
            merged.filter("changed").select(
                "run_id", *KEY, F.col("best.state").alias("sha256"), F.col("best.observation_generation").alias("observation_generation"), "gap"
            ).write.parquet(f"{self.log.folder}/{home}/output")
            state = merged.select(
                *KEY,
                merge_intervals(F.concat(F.coalesce("processed", empty_intervals()), F.coalesce("gap", empty_intervals()))).alias("processed"),
                F.when(F.col("moved"), F.col("best.observation_generation")).otherwise(F.col("old_generation")).alias("observation_generation"),
                F.when(F.col("moved"), F.col("best.state")).otherwise(F.col("old_state")).alias("state"),
            )
            return self._state.write(state, content, touched, home) | {"output": f"{home}/output"}

        version, _ = self.log.change(work, before_commit=before_commit)
        return self.output(version)


def replay_ledger(ledger: IntervalLedger, observations: DataFrame, runs: DataFrame) -> DataFrame:
    """All succeeded runs through the ledger: a step takes the next run of every
    repository. Steps are as many as a repository has runs."""
    wanted = runs.filter((F.col("status") == "succeeded") & F.col("started_at").isNotNull() & F.col("run_id").isNotNull() & F.col("repo_key").isNotNull())
    turns = wanted.select("run_id", "repo_key", "started_at", F.row_number().over(Window.partitionBy("repo_key").orderBy("started_at", "run_id")).alias("turn"))
    turns = cut_lineage(turns)
    for turn in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
        ledger.step(observations, turns.filter(F.col("turn") == turn))
    return ledger.outputs()
