"""Roles of paths, intents, identifiers, and the rerank score on small inputs."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import frontend, intent, rerank

ROLES = {
    "src/stores/modules/auth.store.ts": ("state_store", 20), "src/views/chat/composables/useSseConnection.ts": ("composable", 20), "src/lib/useThing.ts": ("composable", 20), "src/views/chat/types.ts": ("data_type", 45), "src/views/auth/register.vue": ("view", 50),
    "src/main/java/com/example/service/UserService.java": ("service", 30), "src/main/java/com/example/controller/UserController.java": ("entrypoint", 10), "src/utils/usage.ts": ("source", 60), "handler/upload.go": ("handler", 25),
    "middleware/auth.go": ("middleware", 25), "collector/internal/service/fund_service.go": ("service", 30), "collector/internal/repository/nav_repo.go": ("repository", 40), "collector/internal/source/eastmoney/nav.go": ("source_adapter", 40),
    "collector/internal/scheduler/scheduler.go": ("scheduler", 25), "src/main/java/com/example/service/impl/AuthServiceImpl.java": ("service_impl", 10), "src/main/java/com/example/service/PageAppCatalogQueryExe.java": ("executor", 20),
    "src/main/java/com/example/dto/AuthDto.java": ("data_type", 45), "src-tauri/src/commands.rs": ("command", 15), "src-tauri/src/engine.rs": ("engine", 20), "src-tauri/src/settings.rs": ("config", 70), "storage/local.go": ("storage", 30),
    "internal/storages/oss.go": ("storage", 30), "Cargo.lock": ("lockfile", 90), "a/go.sum": ("lockfile", 90), "pnpm-lock.yml": ("lockfile", 90), "Dockerfile": ("deployment_config", 75), "docker-compose.yml": ("deployment_config", 75),
    "docker/image_providers.yaml": ("deployment_config", 75), "docker/.env": ("deployment_config", 75), "docker/entrypoint.sh": ("source", 60), "image_providers.yaml.example": ("config_example", 75), "config/text_providers.yaml": ("runtime_config", 65),
    "config/.env": ("runtime_config", 65), "image_providers.yaml": ("runtime_config", 65), "tsconfig.json": ("config", 70), "history/index.json": ("generated_output", 85), "output/task_1/result.json": ("generated_output", 85), "README.md": ("doc", 80),
    "docs/setup.md": ("doc", 80), "src/test/java/a/B.java": ("test", 90), "a/foo_test.go": ("test", 90), "a/b.spec.ts": ("test", 90), "src/main/resources/application-dev.yml": ("runtime_config", 65),
}


def test_path_roles(spark):
    rows = spark.createDataFrame([(p,) for p in ROLES], "path string")
    got = {r.path: tuple(r.r) for r in rows.select("path", intent.path_role(F.col("path"), F.lit(None).cast("string")).alias("r")).collect()}
    assert got == ROLES


def test_path_roles_by_content(spark):
    rows = [
        ("a/service/AuthService.java", "public interface AuthService {}", "service_interface"),
        ("a/service/AuthService.java", "// public interface X\nclass AuthService {}", "service"),
        ("a/core/Kind.java", "package a;\n\npublic enum Kind { A }", "data_type"),
        ("a/core/Kind.java", 'class Kind { String s = "enum X {"; }', "source"),
        ("a/core/Row.java", "@Entity\n@Table(name = 1)\npublic class Row {}", "data_type"),
        (None, None, "source"),
    ]
    df = spark.createDataFrame([(n, p, c) for n, (p, c, _) in enumerate(rows)], "n int, path string, content string")
    got = {r.n: r.role for r in df.select("n", intent.path_role(F.col("path"), F.col("content"))["name"].alias("role")).collect()}
    assert got == {n: want for n, (_, _, want) in enumerate(rows)}


def intents(spark, query, tokens):
    return intent.with_query_intent(spark.createDataFrame([(query, tokens)], "query_text string, query_tokens array<string>")).first()


def test_query_intents(spark):
    r = intents(spark, "配置页面保存文本服务商和图片服务商 YAML active provider", ["yaml", "active", "provider"])
    assert r.operations == ["save"] and {"config", "ui"} <= set(r.targets) and not r.wants_artifact and r.confidence >= 2
    r = intents(spark, "docker compose deployment yaml mount history output", "docker compose deployment yaml mount history output".split())
    assert "deploy" in r.targets and "config_artifact" in r.artifacts and r.wants_artifact
    r = intents(spark, "历史记录打包下载 zip 接口", ["zip"])
    assert "download" in r.operations and "entrypoint" in r.targets and not r.wants_artifact
    r = intents(spark, "auth portfolio provider history", "auth portfolio provider history".split())
    assert (r.operations, r.targets, r.confidence) == ([], [], 0)
    assert intents(spark, None, []).confidence == 0


@pytest.mark.parametrize(
    "query,exact,identifiers,files",
    [
        ("apply_dev", "apply_dev", ["apply_dev"], []),
        ("find AuditStatus", None, ["AuditStatus"], []),
        ("  INVOLVED_BY_ME  ", "INVOLVED_BY_ME", [], []),
        ("INVOLVED__BY_ME", None, [], []),
        ("(INVOLVED_BY_ME)", None, [], []),
        ("REST", None, [], []),
        ("Owner.MEMBER", None, [], ["owner.member"]),
        ("AuditStatus apply_dev", None, ["AuditStatus", "apply_dev"], []),
        ("HTTPServer2 in main.py, see a/b/util.test.ts!", None, ["HTTPServer2"], ["main.py", "util.test.ts"]),
        ("查询UserService", None, [], []),
        (None, None, [], []),
    ],
)
def test_identifiers(spark, query, exact, identifiers, files):
    r = intent.with_identifiers(spark.createDataFrame([(query, [])], "query_text string, query_tokens array<string>")).first()
    assert (r.exact_identifier, r.identifiers, r.file_hints) == (exact, identifiers, files)


CHUNK = "chunk_id string, path string, names array<string>, symbols array<struct<name:string,start_line:int>>, kinds array<string>, tokens array<string>, content string, start_line int, end_line int, unit string, is_test boolean, is_generated boolean"
CAND = "query_id bigint, query_text string, chunk_id string, score_parts map<string,double>"


def chunk(name, path, content="", tokens=(), unit="u", **more):
    return (name, path, ["Foo"], [("Foo", 3)], more.get("kinds", ["method"]), list(tokens), content, 1, 80, unit, more.get("is_test"), more.get("is_generated"))


def test_rerank_scores(spark):
    chunks = spark.createDataFrame(
        [
            chunk("ctl", "src/controller/FooController.java", tokens=["foo", "save"]),
            chunk("doc", "docs/foo.md", tokens=["foo"]),
            chunk("gen", "src/generated/foo.go", tokens=["foo"], is_generated=True),
            chunk("far", "src/lib/foo.go", tokens=["foo", "save"], unit="other"),
            chunk("none", "src/lib/bar.go", tokens=[]),
        ],
        CHUNK,
    )
    part = {"semantic": 0.4}
    candidates = spark.createDataFrame([(1, "save foo endpoint", c, part) for c in ("ctl", "doc", "gen", "far", "none", "ctl", "lost")], CAND)
    rows = {r.chunk_id: r for r in rerank.rerank(candidates, chunks).collect()}
    assert rows.keys() == {"ctl", "doc", "gen", "far", "none"}
    ctl, doc, gen, far, none = (rows[c] for c in ("ctl", "doc", "gen", "far", "none"))
    # .4 x .55 + .2 x 2/3 + .03, the largest of all; .2 strong, .15 controller, .18 role, .1 logic
    assert abs(ctl.combined - (0.22 + 0.2 * 2 / 3 + 0.03)) < 1e-6 and ctl.normalised == 1.0
    assert abs(ctl.pre_ceiling - (1.0 + 0.2 + 0.15 + 0.18 + 0.10)) < 1e-6 and ctl.position == 1
    # a document: penalised as such (query for logic) and demoted in the display
    assert doc.path_role.name == "doc" and doc.penalty == -0.20 and doc.demotion == 0.45
    assert gen.penalty == -0.20 and gen.file_role == "generated_schema"
    # another project unit than that of the best row
    assert abs(far.below - far.rerank - 0.05) < 1e-6 and ctl.below == ctl.rerank
    assert none.evidence_class == "weak_original_direct" and none.evidence_priority == 1
    assert sorted(r.position for r in rows.values()) == [1, 2, 3, 4, 5]
    assert rerank.rerank(candidates.limit(0), chunks).count() == 0


def test_exact_identifiers_find_their_owner(spark):
    chunks = spark.createDataFrame([chunk("own", "a/x.go"), chunk("use", "a/y.go", content="Foo FooBar")], CHUNK).withColumn("names", F.when(F.col("chunk_id") == "own", F.array(F.lit("FooBar"))).otherwise(F.array(F.lit("q"))))
    chunks = chunks.withColumn("symbols", F.transform("names", lambda n: F.struct(n.alias("name"), F.lit(3).alias("start_line"))))
    rows = {r.chunk_id: r for r in rerank.rerank(spark.createDataFrame([(1, "FooBar", c, {"semantic": 0.1}) for c in ("own", "use")], CAND), chunks).collect()}
    assert (rows["own"].owner_boost, rows["own"].identifier_boost) == (0.5, 0.3)
    assert (rows["use"].owner_boost, rows["use"].identifier_boost) == (0.0, 0.2)


def test_ceiling_of_weaker_rows(spark):
    row = "query_id int, chunk_id string, strong boolean, evidence_priority int, role string, pre_ceiling double, combined double, path string, start_line int, unit string"
    rows = spark.createDataFrame([(1, "a", True, 0, "service", 0.8, 0.5, "p", 1, ""), (1, "b", True, 0, "handler", 0.3, 0.5, "p", 1, ""), (1, "c", False, 1, "generic", 0.9, 0.5, "p", 1, ""), (2, "d", False, 1, "generic", 0.9, 0.5, "p", 1, "")], row)
    got = {r.chunk_id: r for r in rerank.placed(rows).collect()}
    assert got["c"].clamped and abs(got["c"].rerank - 0.8 * (1 - 1e-6)) < 1e-6 and got["c"].position == 2
    assert not got["d"].clamped and got["b"].position == 3


def test_results_and_anchors_are_split(spark):
    rows = [(1, f"c{n}", f"src/f{n % 20}.py", n + 1) for n in range(30)] + [(1, "r", "README.md", 31), (1, "r2", "README.md", 32), (1, "p", "a/pom.xml", 33)]
    got = rerank.split_results(spark.createDataFrame(rows, "query_id int, chunk_id string, path string, position int")).collect()
    assert [r.path for r in sorted(got, key=lambda r: r.place) if r.kind == "result"] == [f"src/f{n}.py" for n in range(12)]
    assert {(r.kind, r.chunk_id) for r in got if r.kind != "result"} == {("readme", "r"), ("pom", "p")}


FRONTEND = {
    "src/views/Home.vue": "view_page", "web/src/pages/a/Index.tsx": "view_page", "pages/index.tsx": "view_page", "src/components/layout/Bar.vue": "layout_component", "src/App.tsx": "layout_component", "src/components/Button.tsx": "shared_component",
    "src/stores/auth.ts": "store", "src/api/user.ts": "service", "src/utils/format.ts": "utility", "src/types/a.ts": "type_decl", "src/env.d.ts": "type_decl", "src/router/index.ts": "route_config", "yarn.lock": "lockfile", "tmp/a.ts": "scratch_temp",
    "src/main.py": "other", "lib/a.ts": "other",
}


def test_frontend_roles(spark):
    got = {r.path: r.role for r in spark.createDataFrame([(p,) for p in FRONTEND], "path string").select("path", frontend.frontend_role(F.col("path")).alias("role")).collect()}
    assert got == FRONTEND


def test_frontend_parts(spark):
    rows = [("image upload tool", "src/views/Home.vue"), ("photo remover page", "src/views/PhotoRemover.vue"), ("decode encode parse", "src/utils/codec.ts"), ("x", "yarn.lock"), ("package versions", "yarn.lock"), ("upload image page", "src/types/zone.ts"), (None, "src/views/Home.vue")]
    df = spark.createDataFrame([(n, q, p) for n, (q, p) in enumerate(rows)], "n int, query_text string, path string")
    got = {r.n: (round(r.entrypoint_boost, 4), round(r.support_boost, 4), r.support_name_boost, r.frontend_penalty) for r in frontend.with_frontend_parts(df).collect()}
    assert got == {0: (0.35, 0.0, 0.0, 0.0), 1: (0.25, 0.0, 0.0, 0.0), 2: (0.0, 0.0972, 0.0, 0.0), 3: (0.0, 0.0, 0.0, -0.8), 4: (0.0, 0.0, 0.0, 0.0), 5: (0.0, 0.0, 0.0, -0.12), 6: (0.0, 0.0, 0.0, 0.0)}


def test_import_cohorts(spark):
    ranked = [(1, "v", "src/views/A.vue", 1.0, 1), (1, "s", "src/services/a.ts", 0.5, 2), (1, "u", "src/utils/u.ts", 0.9, 3), (1, "x", "src/utils/x.ts", 0.4, 4), (1, "p", "a.py", 0.3, 5)]
    imports = spark.createDataFrame([("src/views/A.vue", "src/services/a.ts"), ("src/views/A.vue", "src/utils/u.ts"), ("src/views/A.vue", "a.py")], "source_path string, target_path string")
    got = {r.chunk_id: r.boosted for r in frontend.import_cohorts(spark.createDataFrame(ranked, "query_id int, chunk_id string, path string, rerank double, position int"), imports).collect()}
    assert got == {"s": 0.8, "u": 0.999}


def test_java_context_and_route_tails(spark):
    rows = spark.createDataFrame([(1, "c", "a/B.java", "executor", ["load", "user", "x"], "method", ["Load", "USER"]), (1, "c", "a/B.java", "executor", ["load", "user"], "field", ["load"]), (1, "g", "a/b.go", "executor", ["load", "user"], "method", ["load", "user"])], "query_id int, chunk_id string, path string, role string, query_tokens array<string>, kind string, tokens array<string>")
    assert [tuple(r) for r in frontend.java_context(rows).collect()] == [(1, "c", 0.14, 0.0, 0.10)]
    df = spark.createDataFrame([("/api/pageCatalog", ["AppPageCatalogQueryExe"], "executor"), ("/api/page", ["PageExe"], "executor"), ("/api/pageCatalog", ["PageExe"], "executor"), (None, ["PageExe"], "executor")], "route string, names array<string>, role string")
    assert [r.v for r in df.select(frontend.route_tail(F.col("route"), F.col("names"), F.col("role")).alias("v")).collect()] == [0.22, 0.0, 0.0, 0.0]
