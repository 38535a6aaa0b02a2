"""Queries that find little in the large tables, on small ones where they find something."""

import pytest

from brindle.plans import registry
from tests.oracle import compare

SIGNAL = "signal_id string, chunk_id string, file_path string, kind string, name string, qualified_name string, signature string, arity int, project_unit_key string, start_line int, end_line int, recallable boolean, tokens array<string>, metadata map<string,string>, deleted_at bigint, recorded_at timestamp, language string"
RELATION = "relation_id string, source_signal_id string, source_chunk_id string, source_file_path string, target_name string, kind string, confidence double, target_kind string, target_qualified_name string, target_signature string, target_arity int, target_signal_id string, resolution string, producer_confidence double, resolution_confidence double, deleted_at bigint, recorded_at timestamp"
FILE = "file_id bigint, repo_key string, path string, language string, sha256 string, is_test boolean, is_generated boolean, size bigint, mtime_ns bigint"
RANKED = "query_id bigint, query_text string, chunk_id string, score double, rerank_score double, score_parts map<string,double>, rank_tier int, evidence_class string, evidence_priority int"


def signal(i, chunk, path, kind, name, qualified, deleted=None):
    return (i, chunk, path, kind, name, qualified, "", None, "u", 1, 9, True, [name], {}, deleted, None, "java")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}-parts")
        import pathlib

        part = next(pathlib.Path(f"{d}/{name}-parts").glob("*.parquet"))
        part.rename(f"{d}/{name}.parquet")

    write(
        "code_signals",
        [
            signal("s1", "c1", "r/src/Order.java", "method", "save", "a.Order.save"),
            signal("s2", "c2", "r/src/OrderImpl.java", "method", "save", "a.OrderImpl.save"),
            signal("s3", "c3", "r/docs/order.md", "module", "order", "docs.order"),
            signal("s4", "c4", "r/docs/tool.py", "function", "run", "docs.tool.run"),
            signal("s5", "c5", "r/docs/gone.py", "function", "gone", "docs.gone", 7),
            signal("s6", "c6", "r/src/Order.java", "field", "total", "a.Order.total"),
        ],
        SIGNAL,
    )
    relation = lambda i, name, qualified, resolution="unresolved", target=None: (i, "s1", "c1", "r/src/Order.java", name, "calls", 0.9, "", qualified, "", None, target, resolution, None, None, None, None)
    write("code_relations", [relation("r1", "save", "b.Other.save"), relation("r2", "gone", "x.gone"), relation("r3", "run", "docs.tool.run", "resolved_exact", "s4"), relation("r4", None, None)], RELATION)
    paths = ["pom.xml", "src/Order.java", "test/OrderTest.java", "web/package.json", "web/app.ts", "web/lib/util.ts", "web/app.test.ts", "docs/order.md", "docs/tool.py", "test_tool.py", "tool.py"]
    files = [(n, "r", p, "java", "x", "test" in p.lower(), False, 1, 1) for n, p in enumerate(paths)] + [(90, "q", "src/Order.java", "java", "x", False, False, 1, 1), (91, "q", "gen/Order.java", None, "x", False, True, 1, 1)]
    write("source_files", files, FILE)
    texts = [(n, "import { a } from './lib/util';\nimport b from 'other';\na();\n" if p == "web/app.ts" else f"text of {p}\n") for n, p in enumerate(paths)]
    write("file_texts", texts, "file_id bigint, content string")
    ranked = lambda q, chunk, score, name, priority: (q, "save order", chunk, score, score, {"semantic": score}, 0, name, priority)
    write("ranked_chunks", [ranked(1, "c3", 0.9, "original_direct", 0), ranked(1, "c2", 0.5, "weak_or_generic", 4), ranked(1, "c4", 0.4, "weak_or_generic", 4), ranked(2, "c1", 0.7, "original_direct", 0)], RANKED)
    return d


@pytest.mark.parametrize("name", ["d6_members", "e2_same_directory", "e1_same_file", "e9_test_subjects", "b25_project_units", "b26_deepest_units", "e8_resolution", "d18_maintenance", "d5_named_chunks", "f12_path_roles", "f5_evidence", "f6_rerank", "c3_path_symbol"])
def test_query_equals_its_sql_and_finds_something(spark, folder, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name], folder)
    assert registry.queries()[name](spark, folder).count() > 0


def test_imports_of_scripts_are_resolved(spark, folder):
    rows = registry.queries()["b16_imports"](spark, folder).collect()
    assert [(r.path, r.selector, r.target) for r in rows] == [("web/app.ts", "./lib/util", "web/lib/util.ts")]


def test_members_by_their_bare_name(spark, folder):
    rows = {r.target_qualified_name: r.signals for r in registry.queries()["d6_members"](spark, folder).collect()}
    assert rows == {"b.Other.save": 2}


def test_neighbours_of_documents(spark, folder):
    assert {(r.query_id, r.chunk_id) for r in registry.queries()["e2_same_directory"](spark, folder).collect()} == {(1, "c4")}
