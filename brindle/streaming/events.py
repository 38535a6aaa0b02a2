"""Continuous forms, beyond the batch operators: windowed counts of events with late
data, and changed files from a stream of observations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Events per window and type; works on a stream and on a table."""
    bounded = events.withWatermark("ts", late) if events.isStreaming else events
    counted = bounded.groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    bounded = events.withWatermark("ts", late) if events.isStreaming else events
    counted = bounded.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def changed_files(observations: DataFrame) -> DataFrame:
    """From a stream of observations the files whose newest content changed, as each batch
    shows it: ``repo_key, path, sha256, observation_generation``. State per file is the
    highest number and its digest."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, digest = state.get if state.exists else (-1, "")
        before = digest
        for frame in frames:
            for g, sha in zip(frame["observation_generation"], frame["sha256"]):
                if g > generation:
                    generation, digest = int(g), (sha or "").lower()
        state.update((generation, digest))
        if digest != before:
            yield pd.DataFrame({"repo_key": [key[0]], "path": [key[1]], "sha256": [digest], "observation_generation": [generation]})

    return observations.groupBy("repo_key", "path").applyInPandasWithState(
        step, "repo_key string, path string, sha256 string, observation_generation bigint", "generation bigint, digest string", "append", GroupStateTimeout.NoTimeout
    )
