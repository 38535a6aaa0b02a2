"""Expected behaviour of single operators on small inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import chunking, evaluation, extract, graph, packing, ranking, recall, refresh
from brindle.sources import trees
from brindle.streaming.events import changed_files, windowed_counts


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"]).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text,want",
    [
        ("XMLHttpRequest2 FooBar snake_case ABC", "xml http request 2 foo bar snake case abc"),
        ("café", "caf é"),
        ("élan", "élan"),
        ("支付订单", "支付订单 支付 付订 订单 支付订 付订单"),
        ("", ""),
    ],
)
def test_tokens(spark, text, want):
    assert " ".join(one(spark, T.identifier_tokens(F.col("t")), t=text)) == want


def test_null_text_has_no_tokens_and_no_lines(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(T.identifier_tokens(F.col("t")), T.text_lines(F.col("t"))).first() == ([], [])


def test_line_breaks(spark):
    text = "a\r\nb\rc\x0bd\x85e f\n"
    assert one(spark, T.text_lines(F.col("t")), t=text) == text.splitlines()


def test_chunks(spark):
    text = "\n".join(map(str, range(165)))
    df = spark.createDataFrame([("p", text), ("empty", ""), ("none", None)], "path string, text string")
    got = [(r.path, r.start_line, r.end_line) for r in chunking.line_chunks(df, "path", "text").orderBy("start_line").collect()]
    assert got == [("p", 1, 80), ("p", 81, 160), ("p", 161, 165)]


def test_overlap_counts_each_pair_once(spark):
    left = spark.createDataFrame([("f", 1, 400), ("f", 500, 500)], "k string, start_line int, end_line int")
    right = spark.createDataFrame([("f", 70, 250), ("f", 500, 500), ("f", 401, 499)], "k string, start_line int, end_line int")
    assert sorted((r.start_line, r.r_start) for r in chunking.overlapping(left, right, "k").collect()) == [(1, 70), (500, 500)]


def test_deepest_unit(spark):
    files = spark.createDataFrame([("r", "a/b/pom.xml"), ("r", "a/b/c/x.java"), ("r", "a/y.java"), ("r", "z")], "repo_key string, path string")
    units = chunking.project_units(files, {"pom.xml": "java"})
    assert {r.path: r.unit for r in chunking.deepest_unit(files, units).collect()} == {"a/b/pom.xml": "a/b", "a/b/c/x.java": "a/b", "a/y.java": "", "z": ""}


def test_direct_scores(spark):
    score = lambda hits, strong, probes: one(spark, recall.direct_score(F.lit(hits), F.lit(strong), F.lit(probes)))
    assert [score(1, False, 1), score(1, True, 6), score(6, True, 6)] == [0.5, 0.6, 1.0]


def test_merge_keeps_the_lowest_penalty_and_one_graph_key(spark):
    rows = [("q", "c", 1.0, "penalty", -0.1), ("q", "c", 2.0, "penalty", -0.2), ("q", "c", 1.0, "lexical", 0.2), ("q", "c", 1.0, "lexical", 0.1), ("q", "c", 1.0, "graph_calls_match", 0.5), ("q", "c", 1.0, "graph_tests_match", 0.7)]
    got = recall.merge_evidence(spark.createDataFrame(rows, "q string, c string, score double, key string, value double"), ["q", "c"]).first()
    assert got.score == 2.0 and got.parts == {"penalty": -0.2, "lexical": 0.2, "graph_tests_match": 0.7}


@pytest.mark.parametrize("values,want", [([2.0, 1.0, -1.0], [1.0, 0.5, 0.0]), ([5.0], [1.0]), ([-1.0, 0.0], [0.0, 0.0]), ([float("nan"), 2.0], [0.0, 1.0])])
def test_normalised(spark, values, want):
    df = spark.createDataFrame([(1, n, v) for n, v in enumerate(values)], "g int, n int, v double")
    assert [r.s for r in df.select("n", ranking.max_normalised(F.col("v"), "g").alias("s")).orderBy("n").collect()] == want


def test_expansion_decays_and_keeps_directions(spark):
    schema = "relation_id string, source_signal_id string, target_signal_id string, kind string, resolution string, confidence double, producer_confidence double, resolution_confidence double, deleted_at bigint"
    rows = [("1", "a", "b", "uses_type", "resolved_exact", 0.9, 0.9, 0.95, None), ("2", "b", "c", "implements", "resolved_unique", 1.0, 1.0, 1.0, None), ("3", "x", "a", "calls", "resolved_exact", 1.0, 1.0, 1.0, None), ("4", "a", "d", "calls", "resolved_exact", 0.4, 0.4, 0.4, None), ("5", "a", "e", "calls", "unresolved", 1.0, 1.0, None, None), ("6", "b", "a", "tests", "resolved_exact", 1.0, 1.0, 1.0, 5)]
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id int, signal_id string, score double")
    got = {r.signal_id: (r.score, r.hops) for r in graph.expand(seeds, graph.steps(spark.createDataFrame(rows, schema))).collect()}
    assert got == {"a": (1.0, 0), "b": (0.54, 1), "c": (round(0.54 * 0.76, 9), 2)}


def test_islands(spark):
    spans = spark.createDataFrame([("f", 1, 5), ("f", 3, 4), ("f", 6, 7), ("f", 9, 9)], "p string, start_line int, end_line int")
    assert sorted((r.start_line, r.end_line, r.merged) for r in ranking.islands(spans, ["p"]).collect()) == [(1, 7, 3), (9, 9, 1)]


def test_ceiling(spark):
    rows = [(1, "a", 0.5, 0), (1, "b", 0.9, 1), (1, "c", 0.1, 2), (2, "d", 0.9, 1)]
    got = {r.c: r.clamped for r in ranking.ceiling_clamped(spark.createDataFrame(rows, "q int, c string, rerank_score double, evidence_priority int"), "q").collect()}
    assert got == {"a": False, "b": True, "c": False, "d": False}


def test_exact_vectors_in_blocks(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((120, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, vector array<float>")
    got = recall.exact_vectors(df.filter("vec_id < 9").withColumnRenamed("vec_id", "query_id"), df, 4, block=4).collect()
    unit = vectors.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 6)
    np.fill_diagonal(near, -2)
    for q in range(9):
        want = sorted(range(120), key=lambda j: (-near[q, j], j))[:4]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: (-r.cosine, r.vec_id))] == want
    assert recall.exact_vectors(df.limit(0).withColumnRenamed("vec_id", "query_id"), df, 4).count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, False, True), (1, 2, True, False), (2, 1, False, False)], "c int, position int, relevant boolean, noise boolean")
    got = {r.c: r for r in evaluation.case_metrics(ranked, "c").collect()}
    assert got[1].reciprocal_rank == 0.5 and got[1].precision_5 == 0.2 and got[1].noise_5 == 1 and not got[1].hit_1
    assert got[2].first_rank is None and got[2].reciprocal_rank == 0
    assert evaluation.glob_pattern("src/**/*.py") == r"^src/(?:.*/)?[^/]*\.py$"


def test_diff_and_health(spark):
    schema = "repo_key string, path string, sha256 string, mtime_ns bigint"
    before = spark.createDataFrame([("r", "a", "X", 1), ("r", "b", "y", 1), ("r", "c", "z", 1), ("r", "d", "w", 1)], schema)
    after = spark.createDataFrame([("r", "a", "x", 1), ("r", "b", "q", 1), ("r", "e", "z", 1), ("r", "d", "w", 2)], schema)
    assert {r.path: r.state for r in refresh.snapshot_diff(before, after).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "touched", "e": "added"}
    row = spark.createDataFrame([(False, True, True, True, True, True, True)], "available boolean, compatible boolean, corrupt boolean, writer_idle boolean, stale boolean, degraded boolean, verified boolean")
    assert refresh.health(row).first().health == "missing"


def test_facts():
    java = 'package a.b;\nimport java.util.List;\n@RequestMapping("/api")\npublic class C implements D {\n    @GetMapping("/x")\n    public int run(int a) {\n    }\n}\n'
    got = [(k, q) for k, _, q, *_ in extract.java_facts(java)]
    assert ("type", "a.b.C") in got and ("endpoint", "/api/x") in got and ("method", "a.b.C.run") in got and ("implements", "a.b.C") in got
    python = "import os\nfrom .m import f as g\nX = 1\nclass A:\n    def b(self):\n        import re\n"
    assert {(k, q) for k, _, q, *_ in extract.python_facts(python)} == {("imports", "os"), ("imports", ".m.f"), ("variable", "X"), ("type", "A"), ("function", "A.b"), ("imports", "re")}
    assert list(extract.python_facts("def (")) == []
    assert extract.script_candidates("src/a/b.ts", "../c")[0] == "src/c.ts" and extract.script_candidates("a.ts", "../../x") == [] and extract.script_candidates("a.ts", "react") == []
    assert [q for _, _, q, *_ in extract.statement_facts('<mapper namespace="n"><select id="s">')] == ["n.s", "n.s"]


def test_resolved_imports(spark):
    files = spark.createDataFrame([("src/a.ts", "import { x } from './b';\nimport y from 'pkg';"), ("src/b.js", ""), ("src/b.ts", None)], "path string, content string")
    got = extract.resolved_imports(extract.facts(files), files).collect()
    assert [(r.path, r.selector, r.target) for r in got] == [("src/a.ts", "./b", "src/b.ts")]


def test_hash_embedding_and_provider(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k bigint, t string")
    got = {r.k: r.vector for r in extract.hash_embeddings(df, "k", "t", 16).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-5 and set(got[2]) == {0.0}
    assert {r.k: len(r.vector) for r in extract.embed(df, "k", "t", lambda ts: [[1.0, 2.0]] * len(ts), 2).collect()} == {1: 2, 2: 2}


def test_packs_and_exploration():
    make = lambda path, text, score: packing.Item(path, "source", score, text, [(1, 1)])
    items = [make("a", "alpha", 0.9), make("b", "beta gamma", 0.5), make("c", "gamma", 0.4)]
    needs = [packing.Need("n1", ("beta",)), packing.Need("n2", ("GAMMA",)), packing.Need("n3", ("delta",), False)]
    chosen, missing = packing.cover(items, needs, 2)
    assert [i.path for i in chosen] == ["b", "a"] and [n.name for n in missing] == ["n3"]
    made = packing.pack(items, needs, 2, 40, 8)
    assert made["status"] == "complete" and made["bytes"] <= 40 and made["next_queries"] == ["delta"]
    assert packing.cropped("é" * 5, 3) == "é" and packing.windows([(1, 2), (5, 6), (30, 31)], 40) == [(1, 9), (27, 34)]
    found = packing.explore(lambda q: [i for i in items if q in i.text], [packing.Need("n", ("gamma",))], "alpha")
    assert found["stop"] == "satisfied" and found["asked"] == ["alpha", "gamma"]
    assert packing.explore(lambda q: [], [packing.Need("n", ("x",))], "y")["stop"] == "no_gain"


def test_tree_scan_and_publication(spark, tmp_path):
    root = tmp_path / "tree"
    for name, data in {"src/a.py": b"x = 1\n", "src/b.py": b"\x00\x01", "node_modules/c.js": b"1", "d.unknown": b"1", "e/skip.py": b"1", "f.py": b"\xff\xfe1", "g.py": b"#" * 100}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    scanned = trees.scan_tree(spark, str(root), exclude=["e/"], most_bytes=50)
    assert {r.path: r.state for r in scanned.select("path", "state").collect()} == {"src/a.py": "eligible", "src/b.py": "binary", "node_modules/c.js": "pruned", "d.unknown": "unsupported", "e/skip.py": "excluded", "f.py": "unsupported_encoding", "g.py": "too_large"}
    assert {r.state for r in trees.inventory(scanned).collect()} >= {"eligible", "pruned"}
    published = trees.Publication(spark, str(tmp_path / "published"))
    assert published.publish({"files": scanned.select("path", "state")}) == 1 and published.read("files").count() == 7
    (tmp_path / "a.toml").write_text("[x]\na = 1\nb = 2\n")
    (tmp_path / "b.toml").write_text("[x]\nb = 3\n")
    assert trees.read_config(str(tmp_path / "a.toml"), str(tmp_path / "b.toml"), str(tmp_path / "none.toml")) == {"x": {"a": 1, "b": 3}}
    log = str(tmp_path / "log")
    trees.append_events(spark.range(2), log)
    trees.append_events(spark.range(3), log)
    assert trees.read_events(spark, log, "id bigint").count() == 5
    assert trees.result_markdown(spark.createDataFrame([("a|b", None)], "x string, y string")) == "| x | y |\n| --- | --- |\n| a\\|b |  |"


def test_streams_equal_their_tables(spark, tmp_path):
    base = dt.datetime(2025, 1, 1)
    events = spark.createDataFrame([(i, base + dt.timedelta(hours=i), "a" if i % 3 else "b", 1.0 * i) for i in range(60)], "event_id bigint, ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "events"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("windows").collect()) == sorted(windowed_counts(events).collect())


def test_changed_files_of_a_stream(spark, tmp_path):
    schema = "repo_key string, path string, sha256 string, observation_generation bigint, received_at timestamp"
    folder, base = str(tmp_path / "obs"), dt.datetime(2025, 1, 1)
    batches = [[("r", "a", "X", 1, base), ("r", "b", "y", 1, base)], [("r", "a", "x", 2, base), ("r", "b", "z", 3, base)], [("r", "b", "y", 2, base)]]
    seen = []
    spark.createDataFrame([], schema).write.parquet(folder)
    query = changed_files(spark.readStream.schema(schema).parquet(folder)).writeStream.outputMode("append").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "state")).start()
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [("r", "a", "x", 1), ("r", "b", "y", 1), ("r", "b", "z", 3)]
