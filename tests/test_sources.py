"""Commits, locks, logs, packs, conventions and builds on small inputs."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from brindle.operators import conventions, evaluation, graph, lookup, refresh
from brindle.plans.build import build_index, index_stats
from brindle.session import shared_folder
from brindle.sources import trees
from brindle.sources.commits import WriterLock, rotate


def test_publications_of_two_writers(spark, tmp_path):
    first, second = trees.Publication(spark, str(tmp_path / "p")), trees.Publication(spark, str(tmp_path / "p"))
    done = []

    def other():
        if not done:
            done.append(second.publish({"t": spark.range(5)}))

    assert first.publish({"t": spark.range(3)}, before_commit=other) == 2 and done == [1]
    assert first.read("t").count() == 3 and first.read("t", 1).count() == 5
    with pytest.raises(FileNotFoundError):
        trees.Publication(spark, str(tmp_path / "none")).read("t")


def test_one_writer_holds_the_lock(spark, tmp_path):
    a, b = WriterLock(spark, str(tmp_path)), WriterLock(spark, str(tmp_path))
    with a:
        assert not b.acquire()
        b.release()  # of another's lock does nothing
        assert not b.acquire()
    assert b.acquire()
    late = WriterLock(spark, str(tmp_path), seconds=0)
    time.sleep(1.1)
    assert late.acquire()  # the other is taken for dead
    b.release()
    assert not WriterLock(spark, str(tmp_path)).acquire()


def test_logs_are_moved_aside(spark, tmp_path):
    log = str(tmp_path / "log")
    trees.append_events(spark.range(50), log)
    assert not rotate(spark, log, most_bytes=10_000)
    trees.append_events(spark.range(3), log, most_bytes=10)
    assert trees.read_events(spark, log, "id bigint").count() == 3
    assert trees.read_events(spark, f"{log}.1", "id bigint").count() == 50


def test_packs_fit_their_bytes_exactly(spark):
    rows = spark.createDataFrame([("a", n, "é" * n) for n in range(1, 6)] + [("b", 1, "x" * 500)], "g string, place int, text string")
    got = {r.g: r for r in trees.packed_json(rows, "g", "place", 100).collect()}
    assert got.keys() == {"a"} and got["a"].bytes == len(got["a"].json.encode()) <= 100
    assert [i["place"] for i in json.loads(got["a"].json)] == list(range(1, got["a"].items + 1))
    more = trees.packed_json(rows, "g", "place", got["a"].bytes).filter("g = 'a'").first()
    less = trees.packed_json(rows, "g", "place", got["a"].bytes - 1).filter("g = 'a'").first()
    assert more.items == got["a"].items and less.items == got["a"].items - 1


TARGETS = {
    "src/test/java/a/FooTest.java": ["src/main/java/a/Foo.java"],
    "src/test/java/FooITCase.java": ["src/main/java/Foo.java"],
    "pkg/foo_test.go": ["pkg/foo.go"],
    "tests/a/test_foo.py": ["a/foo.py", "src/a/foo.py"],
    "pkg/test_foo.py": ["pkg/foo.py"],
    "pkg/foo_test.py": ["pkg/foo.py"],
    "a/tests/test_foo.py": [],
    "src/foo_tests.rs": ["src/foo.rs"],
    "web/__tests__/foo.test.ts": ["web/foo.js", "web/foo.jsx", "web/foo.ts", "web/foo.tsx", "web/foo.vue"],
    "web/foo.py": [],
    "Test.java": [],
}


def test_conventions_of_tests(spark):
    df = spark.createDataFrame([(p,) for p in TARGETS], "path string")
    got = {r.path: r.c for r in df.select("path", conventions.production_candidates(F.col("path")).alias("c")).collect()}
    assert got == TARGETS


def test_targets_are_unique_and_plain(spark):
    rows = [("tests/test_a.py", True), ("a.py", False), ("tests/test_b.py", True), ("b.py", False), ("src/b.py", False), ("tests/test_c.py", True), ("fixtures/c.py", False), ("x_test.go", True), ("x.go", None)]
    files = spark.createDataFrame([("r", "u", p, t, False) for p, t in rows], "repo_key string, unit string, path string, is_test boolean, is_generated boolean")
    got = {(r.test_path, r.path) for r in conventions.test_targets(files).collect()}
    assert got == {("tests/test_a.py", "a.py"), ("x_test.go", "x.go")}


def test_seeds_by_source(spark):
    rows = spark.createDataFrame([(1, "a", {"relation": 0.4, "signal": 0.9}), (1, "b", {"planner_signal": 1.0}), (1, "c", {"semantic": 1.0}), (1, "d", {"direct_text": 3.0}), (1, "e", {"same_file_anchor": 0.2})], "query_id int, chunk_id string, score_parts map<string,double>")
    got = {r.chunk_id: (r.source, r.priority, round(r.score, 3)) for r in graph.relation_seeds(rows).collect()}
    assert got == {"a": ("relation", 0, 0.4), "b": ("planner_signal", 4, 0.65), "d": ("direct", 2, 1.0), "e": ("anchor", 3, 0.2)}


def test_tests_are_walked_only_when_asked_for(spark):
    edges = spark.createDataFrame([("a", "b", "calls", 0.8), ("a", "t", "tests", 0.6), ("b", "c", "calls", 0.8)], "from_id string, to_id string, kind string, factor double")
    seeds = spark.createDataFrame([(1, "a", 1.0, False), (2, "a", 1.0, True)], "query_id int, signal_id string, score double, follow_tests boolean")
    got = {(r.query_id, r.signal_id): (round(r.score, 3), r.hops) for r in graph.expand(seeds, edges).collect()}
    assert got == {(1, "a"): (1.0, 0), (1, "b"): (0.8, 1), (1, "c"): (0.64, 2), (2, "a"): (1.0, 0), (2, "b"): (0.8, 1), (2, "c"): (0.64, 2), (2, "t"): (0.6, 1)}


def test_first_ranks_and_order(spark):
    ranked = spark.createDataFrame([("q", "a/x.py", 1), ("q", "b/y.go", 2), ("q", "c/z.md", 3)], "case string, path string, position int")
    targets = spark.createDataFrame(
        [("q", "exact", "b/y.go", None, None), ("q", "part", None, "z.", None), ("q", "glob", None, None, evaluation.glob_pattern("a/*.py")), ("q", "none", "nope", None, None), ("lost", "t", "x", None, None)],
        "case string, target string, path string, contains string, pattern string",
    )
    ranks = evaluation.first_ranks(ranked, targets, "case")
    assert {(r.case, r.target): r.rank for r in ranks.collect()} == {("q", "exact"): 2, ("q", "part"): 3, ("q", "glob"): 1, ("q", "none"): None, ("lost", "t"): None}
    rules = spark.createDataFrame([("q", "glob", "exact", 3), ("q", "part", "glob", 3), ("q", "exact", "none", 1)], "case string, better string, worse string, top_k int")
    assert {(r.better, r.worse): r.holds for r in evaluation.order_checks(ranks, rules, "case").collect()} == {("glob", "exact"): True, ("part", "glob"): False, ("exact", "none"): False}
    assert {r.case: (r.targets, r.covered, r.reciprocal_rank) for r in evaluation.coverage(ranks, "case", 2).collect()} == {"q": (4, 0.5, 1.0), "lost": (1, 0.0, 0.0)}


def test_grouped_metrics_count_each_tag_once(spark):
    cases = spark.createDataFrame([(True, 1.0, 10, "r1", ["a", "a", "b"]), (False, 0.0, 30, "r2", None), (True, 0.5, 20, "r1", ["b"])], "hit_10 boolean, reciprocal_rank double, latency int, repo string, tags array<string>")
    got = {(r.grouping, r.value): (r.cases, r.hits, r.latency_p50, r.latency_p95) for r in evaluation.grouped_metrics(cases, ["repo"], "latency", "tags").collect()}
    assert got == {("overall", "all"): (3, 2, 20, 30), ("repo", "r1"): (2, 2, 10, 20), ("repo", "r2"): (1, 0, 30, 30), ("tag", "a"): (1, 1, 10, 10), ("tag", "b"): (2, 2, 10, 20)}


def test_case_status_and_deltas(spark):
    rows = spark.createDataFrame([(g, f) for g in ("required", "known_gap", "informational") for f in (True, False)], "gate string, failed boolean")
    got = {(r.gate, r.failed): r.s for r in rows.select("gate", "failed", evaluation.case_status(F.col("gate"), F.col("failed")).alias("s")).collect()}
    assert got == {("required", True): "fail", ("required", False): "pass", ("known_gap", True): "expected_gap", ("known_gap", False): "unexpected_pass", ("informational", True): "info", ("informational", False): "pass"}
    a, b = spark.createDataFrame([(0.5,), (1.0,)], "m double"), spark.createDataFrame([(0.25,)], "m double")
    assert evaluation.metric_deltas(a, b, ["m"]).first() == ("m", 0.75, 0.25, -0.5)


def test_null_digests_in_snapshots(spark):
    schema = "repo_key string, path string, sha256 string, mtime_ns bigint"
    before = spark.createDataFrame([("r", "a", None, 1), ("r", "b", "X", 1), ("r", "c", "x", 1), ("r", "gone", None, 1)], schema)
    after = spark.createDataFrame([("r", "a", None, 1), ("r", "b", None, 1), ("r", "c", "X", 2), ("r", "new", None, 1)], schema)
    assert {r.path: r.state for r in refresh.snapshot_diff(before, after).collect()} == {"a": "unchanged", "b": "changed", "c": "touched", "gone": "deleted", "new": "added"}


def test_upserts_and_purges(spark):
    base = spark.createDataFrame([(1, "x", 10), (1, "y", 11), (2, "x", 12), (None, "x", 13)], "c int, k string, v int")
    changes = spark.createDataFrame([(1, "x", 20), (3, "x", 21)], "c int, k string, v int")
    removed = spark.createDataFrame([(2,)], "c int")
    assert {r.v for r in refresh.upserted(base, changes, removed, ["c", "k"], "c").collect()} == {20, 11, 21, 13}
    rows = spark.createDataFrame([(n, n if n < 4 else None) for n in range(10)], "id int, deleted_at bigint")
    assert sorted(r.id for r in refresh.purged(rows, "id", batch=2).collect()) == list(range(2, 10))
    assert refresh.purged(rows, "id", share=0.9).count() == 10


def test_chunks_in_the_order_asked_for(spark):
    wanted = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, "lost", 0)], "query_id int, chunk_id string, place int")
    chunks = spark.createDataFrame([("a", "p"), ("b", "q")], "chunk_id string, path string")
    assert [(r.place, r.chunk_id) for r in lookup.chunks_for_ids(wanted, chunks).orderBy("place").collect()] == [(1, "b"), (2, "a")]


def test_build_publishes_a_whole_index(spark, tmp_path):
    root, index = tmp_path / "src", str(tmp_path / "index")
    os.makedirs(root / "pkg")
    (root / "pkg" / "a.py").write_text("def run():\n    return 1\n" * 50)
    (root / "b.bin").write_bytes(b"\x00\x01")
    assert build_index(spark, str(root), index) == 1
    rows = {r.table: r.rows for r in index_stats(spark, index).collect()}
    assert rows["files"] == 2 and rows["chunks"] == 2 and rows["postings"] > 0 and rows["facts"] > 0
    (root / "pkg" / "c.py").write_text("x = 1\n")
    assert build_index(spark, str(root), index) == 2
    assert {r.table: r.rows for r in index_stats(spark, index).collect()}["chunks"] == 3


def test_a_cluster_has_to_name_its_folder(spark):
    assert shared_folder(spark)


def test_changes_of_cases(spark):
    schema = "id string, gate string, status string, reciprocal_rank double, hit_5 boolean, noise_5 int"
    row = lambda i, gate="required", status="pass", rank=1.0, hit=True, noise=0: (i, gate, status, rank, hit, noise)
    before = [row("same"), row("rank"), row("noise"), row("fails"), row("weak"), row("strong", "known_gap"), row("gone"), row("gone2", "informational"), row("fixed", status="fail"), row("lost", status="fail"), row("null", None), row("info", "informational", rank=0.2, hit=False)]
    after = [row("same", rank=0.8), row("rank", rank=0.5), row("noise", noise=2), row("fails", status="fail"), row("weak", "known_gap"), row("strong"), row("new"), row("fixed"), row("lost", status="skipped"), row("null", None), row("info", "informational")]
    got = {r.id: (r.change, r.stops) for r in evaluation.compare_cases(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), "id").collect()}
    assert got == {
        "same": ("unchanged_pass", False), "rank": ("regressed", True), "noise": ("regressed", True), "fails": ("regressed", True), "weak": ("gate_weakened", True), "strong": ("gate_strengthened", False), "gone": ("removed_required", True),
        "gone2": ("removed_observation", False), "fixed": ("improved", False), "lost": ("coverage_lost_required", True), "null": ("unchanged_pass", False), "new": ("new_case", False), "info": ("changed", False),
    }
