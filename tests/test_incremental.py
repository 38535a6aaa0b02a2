import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions.intervals import INTERVALS, in_intervals, merge_intervals, points_to_intervals, subtract_intervals
from brindle.operators.incremental import IntervalLedger, replay_ledger, replay_runs

OBS = "repo_key string, path string, sha256 string, observation_generation bigint, received_at timestamp"
RUNS = "run_id bigint, repo_key string, status string, started_at timestamp"


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def brute(observations, runs):
    """The definition, run by run."""
    found = set()
    last = {}
    for run, repo, status, start in sorted(runs, key=lambda r: (r[3] or day(0), r[0])):
        if status != "succeeded" or start is None:
            continue
        known = {}
        for r, p, sha, gen, seen in observations:
            if None in (r, p, gen, seen) or r != repo or seen > start:
                continue
            if p not in known or (gen, sha.lower()) > known[p]:
                known[p] = (gen, sha.lower())
        for p, (_, sha) in known.items():
            if last.get((repo, p)) != sha:
                found.add((run, p))
                last[(repo, p)] = sha
    return found


def make(seed, files=6, generations=8):
    rnd = random.Random(seed)
    observations, runs, run = [], [], 0
    for repo in ("a", "b"):
        for g in range(1, generations):
            for f in range(files):
                if rnd.random() < 0.7:
                    sha = rnd.choice("xyz")
                    row = (repo, f"f{f}", sha if rnd.random() < 0.5 else sha.upper(), g, day(g + (rnd.random() < 0.3) * rnd.randint(1, 4)))
                    observations += [row] * rnd.choice([1, 1, 2])
            for _ in range(rnd.randint(1, 2)):
                run += 1
                runs.append((run, repo, rnd.choice(["succeeded", "succeeded", "failed", "aborted", "running"]), day(g + 0.5 + rnd.random() * 0.4)))
    return observations, runs


def test_interval_arithmetic(spark):
    row = spark.range(1).select(
        merge_intervals(F.expr(f"cast(array(struct(5,7),struct(1,2),struct(3,3),struct(9,9)) as {INTERVALS})")).alias("merged"),
        subtract_intervals(F.expr(f"cast(array(struct(1,10)) as {INTERVALS})"), F.expr(f"cast(array(struct(2,3),struct(7,20)) as {INTERVALS})")).alias("left"),
        points_to_intervals(F.expr("array(3L, 1L, 2L, null, 7L, 2L)")).alias("points"),
        in_intervals(F.lit(4), F.expr(f"cast(array(struct(1,3),struct(5,6)) as {INTERVALS})")).alias("inside"),
        merge_intervals(F.lit(None).cast(INTERVALS)).alias("none"),
    ).first()
    assert [tuple(x) for x in row.merged] == [(1, 3), (5, 7), (9, 9)]
    assert [tuple(x) for x in row.left] == [(1, 1), (4, 6)]
    assert [tuple(x) for x in row.points] == [(1, 3), (7, 7)]
    assert row.inside is False and row.none == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_the_definition(spark, seed):
    observations, runs = make(seed)
    found = replay_runs(spark.createDataFrame(observations, OBS), spark.createDataFrame(runs, RUNS))
    assert {(r.run_id, r.path) for r in found.collect()} == brute(observations, runs)


def test_nulls_empty_tables_and_clashing_columns(spark):
    observations, runs = make(4, files=2, generations=3)
    observations += [(None, "f", "x", 1, day(1)), ("a", None, "x", 1, day(1)), ("a", "f", "x", None, day(1)), ("a", "f", "x", 1, None)]
    runs += [(None, "a", "succeeded", day(1)), (99, "a", "succeeded", None), (98, None, "succeeded", day(2)), (97, "a", None, day(2))]
    wide = spark.createDataFrame(observations, OBS).withColumns({c: F.lit(1) for c in ("at", "run", "timeline", "gap", "state", "started_at")})
    found = replay_runs(wide, spark.createDataFrame(runs, RUNS).withColumn("path", F.lit("p")))
    assert {(r.run_id, r.path) for r in found.collect()} == brute(observations, [r for r in runs if None not in r])
    assert replay_runs(spark.createDataFrame([], OBS), spark.createDataFrame([], RUNS)).count() == 0


def stop():
    raise RuntimeError("stopped before the commit")


def test_ledger_survives_a_failure_and_late_rows(spark, tmp_path):
    observations, runs = make(7, files=3, generations=4)
    df = spark.createDataFrame(observations, OBS)
    ledger = IntervalLedger(spark, str(tmp_path / "ledger"), buckets=2)
    found, failed = set(), False
    for run, repo, status, start in sorted(runs, key=lambda r: (r[3], r[0])):
        if status != "succeeded":
            continue
        if not failed:
            with pytest.raises(RuntimeError):
                ledger.run(df, run, repo, start, before_commit=stop)
            failed = True
            assert ledger.version() == 0
        found |= {(r.run_id, r.path) for r in ledger.run(df, run, repo, start).collect()}
    assert found == brute(observations, runs)


def test_replay_through_the_ledger_equals_the_definition(spark, tmp_path):
    observations, runs = make(5, files=3, generations=4)
    ledger = IntervalLedger(spark, str(tmp_path / "ledger"), buckets=2)
    found = replay_ledger(ledger, spark.createDataFrame(observations, OBS), spark.createDataFrame(runs, RUNS))
    assert {(r.run_id, r.path) for r in found.collect()} == brute(observations, runs)


def test_two_writers_lose_and_repeat_nothing(spark, tmp_path):
    rows = [("a", "f1", "x", 1, day(1)), ("a", "f2", "y", 1, day(1)), ("b", "f3", "z", 1, day(1)), ("a", "f1", "w", 2, day(3))]
    df = spark.createDataFrame(rows, OBS)
    folder = str(tmp_path / "ledger")
    first, second = IntervalLedger(spark, folder, buckets=2), IntervalLedger(spark, folder, buckets=2)
    done = []

    def other():
        # Another writer commits between this one's read and its commit, once.
        if not done:
            done.append(1)
            second.run(df, 2, "b", day(2))

    out = first.run(df, 1, "a", day(2), before_commit=other)
    assert {(r.run_id, r.path) for r in out.collect()} == {(1, "f1"), (1, "f2")}
    assert first.version() == 2
    assert sorted((r.run_id, r.path) for r in first.outputs().collect()) == [(1, "f1"), (1, "f2"), (2, "f3")]
    # The same run by two writers: what the other has committed is not given out again.
    done.clear()

    def same():
        if not done:
            done.append(1)
            second.run(df, 3, "a", day(4))

    assert first.run(df, 4, "a", day(4), before_commit=same).count() == 0
    assert sorted((r.run_id, r.path) for r in first.outputs().collect()) == [(1, "f1"), (1, "f2"), (2, "f3"), (3, "f1")]
    assert {r.path: [tuple(x) for x in r.processed] for r in first.state().collect()} == {"f1": [(1, 2)], "f2": [(1, 1)], "f3": [(1, 1)]}
    # A writer that dies between writing and committing changes nothing.
    with pytest.raises(RuntimeError):
        second.run(df.withColumn("observation_generation", F.lit(9)), 5, "a", day(4), before_commit=stop)
    assert first.version() == 4 and first.state().count() == 3
    assert first.log.clean(keep=1, seconds=0) > 0
    assert first.state().count() == 3
