"""The rerank score of a candidate: evidence, roles, intents and penalties over the
normalised linear score, for all queries in one pass."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions.text import distinct_lower, identifier_tokens
from brindle.operators.intent import path_role, with_identifiers, with_query_intent
from brindle.operators.ranking import max_normalised, part

# Suffixes by which a file is source, template, document or configuration, lock
# files, and words that ask for an implementation or for a lock file.
SOURCE = r"\.(?:go|rs|java|kts?|scala|pyw?|tsx?|jsx?|mjs|cjs|c|h|cc|cpp|cxx|hpp|hh|hxx|cs|swift|php|rb|lua|dart|sh|bash|zsh|fish)$"
TEMPLATE, DOC = r"\.(?:html|vue|svelte)$", r"\.(?:mdx?|rst)$"
CONFIG = r"\.(?:jsonc?|ya?ml|toml|ini|cfg|conf|properties|env|xml)$"
LOCKFILE = r"(?:^|/)(?:cargo\.lock|go\.sum|package-lock\.json|pnpm-lock\.ya?ml|yarn\.lock)$"
IMPLEMENTATION_WORDS = "handler middleware command engine service controller storage upload delete apply restore invoke route function class method"
LOCK_WORDS = "dependencies dependency lock lockfile lockfiles package packages version versions"
TEST, GENERATED = r"/test/|test\.java$", r"(?:^|/)generated/|(?:^|/)gen/(?:.*/)?[^/]*\.(?:json|ya?ml)$|(?:^|/)gen/.*schema|schema.*/gen/"

# Penalties of artifacts that a query did not ask for.
ARTIFACT_PENALTIES = {"doc": 0.45, "test": 0.25, "deployment_config": 0.35, "config_example": 0.35, "runtime_config": 0.25, "config": 0.20, "generated_output": 0.45, "lockfile": 0.35}
# What a chunk does, with its priority, boost and penalty.
CHUNK_ROLES = {
    "entrypoint": (0, 0.18, 0.0), "service_impl": (1, 0.12, 0.0), "executor": (2, 0.12, 0.0), "data_type": (3, 0.04, 0.0), "service_interface": (4, 0.06, 0.0), "service": (2, 0.0, 0.0),
    "mapper": (4, 0.03, 0.0), "handler": (5, 0.0, 0.10), "constant_or_config": (6, 0.0, 0.12), "generic": (5, 0.0, 0.0),
}
LOGIC_ROLES = ("entrypoint", "router", "service", "service_impl", "service_interface", "executor", "handler", "middleware", "repository", "source_adapter", "storage", "command", "engine", "scheduler", "state_store", "composable", "view", "component")
CONFIG_LOGIC_ROLES = ("entrypoint", "router", "service", "service_impl", "handler", "state_store", "composable", "view", "component")
CONFIG_ARTIFACT_ROLES = ("deployment_config", "config_example", "runtime_config", "lockfile")
FIRM_ROLES = ("state_store", "composable", "command", "engine", "handler", "middleware", "service", "repository", "source_adapter", "storage")
RELATION_ROLES = ("service_impl", "executor", "data_type", "service_interface", "mapper")
GRAPH_KEYS = tuple(f"graph_{k}_match" for k in ("calls", "implements", "uses_type", "imports", "routes_to", "mapped_by", "tests"))


def _has(column: str, *names: str) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(n) for n in names]))


def chunk_role(path: Column, names: Column, content: Column) -> Column:
    """The role of a chunk by path, names of symbols and content, the first that fits."""
    low, named, text = F.lower(path), F.lower(F.array_join(names, " ")), F.lower(content)
    both, everything = F.concat_ws(" ", low, named), F.concat_ws(" ", low, named, text)
    stems = F.concat(F.array(F.regexp_replace(F.element_at(F.split(low, "/"), -1), r"\.[^.]+$", "")), F.transform(names, lambda n: F.lower(n)))
    return (
        F.when(low.rlike(TEST), "generic")
        .when(both.contains("controller"), "entrypoint")
        .when(low.contains("/service/impl/") | both.contains("serviceimpl"), "service_impl")
        .when(F.exists(stems, lambda s: s.rlike("(?:executor|exe)$")), "executor")
        .when(low.rlike("/(?:dto|vo|query|entity)/"), "data_type")
        .when(low.contains("/service/") & text.contains("interface "), "service_interface")
        .when(low.contains("/service/"), "service")
        .when(low.rlike("/mappers?/") | named.contains("mapper"), "mapper")
        .when(everything.rlike("handler|listener|callback|connector|webhook"), "handler")
        .when(everything.rlike("constant|config|buildermanager|parambuilder"), "constant_or_config")
        .otherwise("generic")
    )


def _of_role(column: str, at: int) -> Column:
    values = {name: value[at] for name, value in CHUNK_ROLES.items()}
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column))


def with_noise(rows: DataFrame) -> DataFrame:
    """Adds ``file_role`` (what the file is to the query), ``noise`` (its penalty, not above
    0), ``source_boost`` and ``lockfile_asked``. A view written as a template is source."""
    low = F.lower(F.coalesce("path", F.lit("")))
    words = F.transform("query_tokens", lambda t: F.lower(t))
    asks_logic = F.contains("query_text", F.lit("/")) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in IMPLEMENTATION_WORDS.split()]))
    lock_asked = F.arrays_overlap(words, F.array(*[F.lit(w) for w in LOCK_WORDS.split()])) | (low.rlike(r"(?:^|/)go\.sum$") & (F.array_contains(words, "gosum") | (F.array_contains(words, "go") & F.array_contains(words, "sum"))))
    is_test = low.rlike(TEST) | F.coalesce("is_test", F.lit(False))
    is_generated = low.rlike(GENERATED) | F.coalesce("is_generated", F.lit(False))
    lockfile = low.rlike(LOCKFILE)
    ui_template = low.rlike(TEMPLATE) & low.rlike(r"(?:^|/)(?:views?|pages?|layouts?|components?)/")
    role = (
        F.when(is_test, "test").when(is_generated, "generated_schema").when(lockfile, "lockfile").when(ui_template, "source").when(low.rlike(TEMPLATE), "template")
        .when(low.rlike(DOC), "doc").when(low.rlike(CONFIG), "config").when(low.rlike(SOURCE), "source").otherwise("unknown")
    )
    named = rows.withColumn("file_role", role)
    by_role = F.when(F.col("file_role") == "template", -0.08).when(F.col("file_role").isin("doc", "config"), -0.03).otherwise(0.0)
    # Of several penalties the largest holds, not their sum.
    noise = F.least(
        F.when(is_generated | low.contains("generated"), -0.20).otherwise(0.0),
        F.when(is_test, -0.10).otherwise(0.0),
        F.when(lockfile & ~lock_asked, -0.20).otherwise(0.0),
        F.when(asks_logic, by_role).otherwise(0.0),
    )
    return named.withColumns({"noise": noise, "source_boost": F.when(F.col("file_role") == "source", 0.03).otherwise(0.0), "lockfile_asked": lockfile & lock_asked})


def with_identifier_match(rows: DataFrame) -> DataFrame:
    """Adds ``identifier_boost`` (at most .40), ``owner_boost`` (.50 where the asked symbol
    begins in the chunk), ``file_hint`` and the boost or penalty of a hinted role."""
    low, text = F.lower(F.coalesce("path", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    stem = F.regexp_replace(F.element_at(F.split(low, "/"), -1), r"\.[^.]+$", "")
    symbols = F.transform("names", lambda n: F.lower(n))
    asked = F.array_distinct(F.array_compact(F.concat("identifiers", F.array("exact_identifier"))))
    in_name = lambda i: F.array_contains(symbols, F.lower(i)) | (F.lower(i) == stem) | F.contains(low, F.lower(i))
    named = rows.withColumns({"_named": F.size(F.filter(asked, in_name)), "_said": F.size(F.filter(asked, lambda i: ~in_name(i) & F.contains(text, F.lower(i)))), "file_hint": F.exists("file_hints", lambda h: F.contains(low, h))})
    hinted = F.when(F.col("file_hint"), 0.40).when(F.exists("file_hints", lambda h: F.contains(text, h)), 0.30).otherwise(0.0)
    base = F.greatest(hinted, F.when(F.col("_named") > 0, 0.30).when(F.col("_said") > 0, 0.20).otherwise(0.0))
    several = F.col("_named") + F.col("_said")
    repeated = F.when(several > 2, F.least(F.lit(0.15), 0.05 * (several - 1) + 0.05)).when(several > 1, 0.05).otherwise(0.0)
    named = named.withColumn("identifier_boost", F.least(F.lit(0.40), base + repeated))
    owner = F.exists("symbols", lambda s: (s["name"] == F.col("exact_identifier")) & (s["start_line"] >= F.col("start_line")) & (s["start_line"] <= F.col("end_line")))
    hints = F.col("role_hints")
    fits = F.array_contains(hints, F.col("path_role.name")) | (F.col("path_role.name").isin("service_impl", "service_interface") & F.array_contains(hints, "service"))
    firm = F.arrays_overlap(hints, F.array(*[F.lit(r) for r in FIRM_ROLES]))
    return named.withColumns(
        {
            "owner_boost": F.when(owner, 0.50).otherwise(0.0),
            "role_hint_boost": F.when(fits & (F.col("path_role.name") == "service_interface"), 0.08).when(fits, 0.14).otherwise(0.0),
            "role_mismatch": F.when((F.col("identifier_boost") <= 0) & firm & ~fits, -0.08).otherwise(0.0),
        }
    ).drop("_named", "_said")


def with_intent_parts(rows: DataFrame) -> DataFrame:
    """Adds ``intent_boost`` (what the query's intent adds to a path of this role) and
    ``intent_penalty`` (artifacts in the way of a query for logic)."""
    role = F.col("path_role.name")
    operating = F.size("operations") > 0
    asks_logic = operating & ((F.size("targets") > 0) | (F.size("artifacts") > 0))
    wants = lambda target: _has("targets", target) & F.col("wants_artifact")
    boost = (
        F.when(operating & _has("targets", "entrypoint", "implementation", "ui") & role.isin(*LOGIC_ROLES), 0.10).otherwise(0.0)
        + F.when(_has("targets", "config") & role.isin(*CONFIG_LOGIC_ROLES), 0.12).otherwise(0.0)
        + F.when(wants("deploy") & (role == "deployment_config"), 0.18).otherwise(0.0)
        + F.when(wants("doc") & (role == "doc"), 0.12).otherwise(0.0)
        + F.when(wants("test") & (role == "test"), 0.12).otherwise(0.0)
    )
    in_the_way = asks_logic & ~F.col("wants_artifact")
    penalty = F.when(in_the_way & role.isin(*CONFIG_ARTIFACT_ROLES), -0.35).when(in_the_way & (role == "generated_output"), -0.45).when(in_the_way & role.isin("doc", "test"), -0.20).otherwise(0.0)
    return rows.withColumns({"intent_boost": boost, "intent_penalty": penalty})


def artifact_demotion() -> Column:
    """The penalty of an artifact in the display, 0 where the query asks for its kind."""
    role = F.col("path_role.name")
    hinted = F.col("file_hint") | (F.col("role_hint_boost") > 0) | (part("project_file_hint_boost") > 0) | (part("project_path_hint_boost") > 0)
    wants = F.col("wants_artifact")
    asked = (
        hinted
        | ((role == "doc") & _has("targets", "doc") & wants)
        | ((role == "test") & _has("targets", "test") & wants)
        | (role.isin("config", "runtime_config", "config_example", "deployment_config") & _has("targets", "config", "deploy") & wants)
        | ((role == "lockfile") & (F.col("lockfile_asked") | (wants & _has("artifacts", "config_artifact"))))
        | ((role == "generated_output") & wants & _has("artifacts", "generated_artifact"))
    )
    table = F.create_map(*[F.lit(x) for pair in ARTIFACT_PENALTIES.items() for x in pair])
    penalty = F.coalesce(F.element_at(table, role), F.lit(0.0))
    return F.when(asked | ((role == "config") & (F.col("source_boost") > 0)), 0.0).otherwise(penalty)


def direct_evidence() -> tuple[Column, Column]:
    """Whether a candidate has strong, and whether any, evidence of the query itself."""
    coverage = F.col("token_coverage")
    strong = (
        ((coverage >= 0.2) & ((part("semantic") >= 0.35) | (part("lexical") >= 0.25)))
        | (part("path_symbol") >= 1.0) | (part("signal") >= 0.5) | (coverage >= 0.5) | (part("direct_text") >= 0.60)
    )
    some = (coverage > 0) | functools.reduce(Column.__or__, [part(k) > 0 for k in ("semantic", "lexical", "path_symbol", "signal", "direct_text")])
    return strong, some


def _any_part(*keys: str) -> Column:
    return functools.reduce(Column.__or__, [part(k) > 0 for k in keys])


def with_evidence(rows: DataFrame) -> DataFrame:
    """Adds ``strong``, ``evidence_class`` and ``evidence_priority`` (0 to 4)."""
    strong, some = direct_evidence()
    planner = _any_part("planner_semantic", "planner_lexical", "planner_signal", "planner_path_symbol")
    name = (
        F.when(strong, "original_direct").when(some, "weak_original_direct").when(planner, "planner_direct")
        .when(_any_part("original_relation", "graph_seed_original"), "original_relation").when(_any_part("planner_relation", "graph_seed_planner"), "planner_relation").otherwise("weak_or_generic")
    )
    order = F.create_map(*[F.lit(x) for pair in {"original_direct": 0, "weak_original_direct": 1, "planner_direct": 1, "original_relation": 2, "planner_relation": 3, "weak_or_generic": 4}.items() for x in pair])
    named = rows.withColumns({"strong": strong, "some_direct": some, "evidence_class": name})
    return named.withColumn("evidence_priority", F.element_at(order, F.col("evidence_class")))


def linear_score() -> Column:
    """The linear score over the parts, the coverage, the boost of source files, and the
    largest penalty."""
    bounded = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), part(k)))
    planner = F.when(part("planner_semantic") > 0, part("planner_semantic") * 0.85).otherwise(0.0)
    score = (
        F.greatest(part("semantic"), planner) * 0.55 + part("lexical") * 0.25 + F.least(part("path_symbol"), F.lit(5.0)) / 5 * 0.15 + part("planner_lexical") * 0.12
        + F.least(part("planner_path_symbol"), F.lit(5.0)) / 5 * 0.07 + bounded("signal") + bounded("planner_signal") * 0.65 + bounded("relation") + bounded("original_relation") + bounded("planner_relation")
        + F.greatest(*[bounded(k) for k in GRAPH_KEYS]) + bounded("anchored_relation") * 0.75 + F.col("token_coverage") * 0.20 + bounded("direct_text") * 0.45
    )
    return score + F.col("source_boost") + F.col("penalty")


def rerank_score() -> Column:
    """The normalised score with its boosts and penalties, before any ceiling."""
    role, path_symbol, coverage, direct = F.col("role"), part("path_symbol"), F.col("token_coverage"), part("direct_text")
    related = _any_part("relation", "original_relation", "planner_relation", "resolved_relation", *GRAPH_KEYS)
    hinted_file = (part("project_path_hint_boost") > 0) | (part("project_file_hint_boost") > 0)
    certain = hinted_file & (path_symbol >= 4.0) & (coverage >= 0.5) & (direct >= 0.60)
    evidence = F.when(F.col("penalty") < 0, 0.0).when(F.col("strong"), 0.2).when(F.col("some_direct"), 0.05).otherwise(0.0)
    endpoint = ((part("signal") > 0) & F.array_contains("kinds", "endpoint")) | ((F.col("penalty") == 0) & F.contains(F.lower("path"), F.lit("controller")))
    exact_role = (
        F.when((role == "entrypoint") & (path_symbol >= 4.0) & (coverage >= 0.5), 0.12)
        .when(role.isin("service_impl", "service") & (path_symbol >= 4.0) & (coverage >= 0.5), 0.35)
        .when((role == "data_type") & (path_symbol >= 2.0) & (coverage >= 0.2), 0.24)
        .when((role == "handler") & certain, 0.08)
        .otherwise(0.0)
    )
    intent_counts = (coverage >= 0.35) | (path_symbol >= 1.5) | (direct >= 0.55) | (part("lexical") >= 0.35)
    in_scope = (
        F.when(endpoint, 0.15).otherwise(0.0)
        + F.when(related, 0.1).otherwise(0.0)
        + _of_role("role", 1)
        + exact_role
        + F.when(certain, 0.40).otherwise(0.0)
        + F.col("identifier_boost") + F.col("owner_boost") + F.col("role_hint_boost") + F.col("role_mismatch")
        + F.when(intent_counts, F.col("intent_boost")).otherwise(0.0)
        + F.when((role == "service_impl") & (path_symbol >= 1.0) & (coverage >= 0.25), 0.18).otherwise(0.0)
        + F.when(related & role.isin(*RELATION_ROLES), 0.08).otherwise(0.0)
    )
    routes = (
        F.when(part("route_exact_match") > 0, part("route_exact_match")).when(part("route_prefix_match") > 0, part("route_prefix_match"))
        .when(part("route_sibling_penalty") < 0, part("route_sibling_penalty")).when(part("route_mismatch_penalty") < 0, part("route_mismatch_penalty")).otherwise(0.0)
    )
    always = (
        F.col("normalised") + evidence - F.when((role == "handler") & certain, 0.0).otherwise(_of_role("role", 2)) - F.col("demotion") + routes + part("route_tail_context_match")
        - F.when(related & role.isin("handler", "constant_or_config"), 0.06).otherwise(0.0)
    )
    return always + F.when(part("project_scope_mismatch_penalty") < 0, 0.0).otherwise(in_scope)


def rerank(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates of all queries with their features and scores, in order.

    ``candidates`` has ``query_id, query_text, chunk_id, score_parts``; ``chunks`` has
    ``chunk_id, path, names, symbols (name, start_line), kinds, tokens, content, start_line,
    end_line, unit, is_test, is_generated``. Adds among others ``path_role, role, file_role,
    penalty, token_coverage, combined, normalised, demotion, pre_ceiling, clamped, rerank,
    position``. Candidates without a chunk, and repeated rows, are left out; an empty table
    gives no rows. Features are one projection per row; the only windows are those of a
    query, over rows of scores.
    """
    texts = with_identifiers(with_query_intent(candidates.select("query_id", "query_text").distinct().withColumn("query_tokens", distinct_lower(identifier_tokens(F.col("query_text"))))))
    rows = candidates.select("query_id", "chunk_id", "score_parts").dropDuplicates(["query_id", "chunk_id"]).join(texts, "query_id")
    known = chunks.withColumns(
        {
            "path_role": path_role(F.col("path"), F.col("content")),
            "role": chunk_role(F.col("path"), F.col("names"), F.coalesce("content", F.lit(""))),
            "held": F.array_union(F.transform("tokens", lambda t: F.lower(t)), distinct_lower(identifier_tokens(F.col("content")))),
        }
    )
    rows = rows.join(known, "chunk_id")
    covered = F.size(F.filter("query_tokens", lambda t: F.array_contains("held", t)))
    rows = rows.withColumn("token_coverage", F.when(F.size("query_tokens") > 0, covered / F.size("query_tokens")).otherwise(0.0)).drop("held")
    rows = with_intent_parts(with_identifier_match(with_noise(rows)))
    rows = rows.withColumns({"penalty": F.least(part("penalty"), F.col("noise"), F.col("intent_penalty")), "demotion": artifact_demotion()})
    rows = with_evidence(rows).drop("content")
    rows = rows.withColumn("combined", F.round(linear_score(), 9))
    rows = rows.withColumn("normalised", max_normalised(F.col("combined"), "query_id"))
    rows = rows.withColumn("pre_ceiling", F.round(rerank_score(), 9))
    return placed(rows)


def placed(rows: DataFrame) -> DataFrame:
    """Ceiling, cohort penalty and the total order. The ceiling is that of the weakest strong
    row that is no detail (handler, constant), or of the weakest strong one if all are."""
    query = Window.partitionBy("query_id")
    anchors = F.min(F.when(F.col("strong") & ~F.col("role").isin("handler", "constant_or_config"), F.col("pre_ceiling"))).over(query)
    ceiling = F.coalesce(anchors, F.min(F.when(F.col("strong"), F.col("pre_ceiling"))).over(query)) * (1 - 1e-6)
    rows = rows.withColumn("ceiling", ceiling)
    clamped = (F.col("evidence_priority") > 0) & F.coalesce(F.col("pre_ceiling") > F.col("ceiling"), F.lit(False))
    rows = rows.withColumn("clamped", clamped).withColumn("below", F.when(F.col("clamped"), F.col("ceiling")).otherwise(F.col("pre_ceiling")))
    first = F.max(F.struct("below", "chunk_id", "unit")).over(query)
    named = F.when(F.coalesce("unit", F.lit("")) != "", F.col("unit"))
    several = F.min(named).over(query) != F.max(named).over(query)
    astray = F.coalesce(several, F.lit(False)) & (F.coalesce("unit", F.lit("")) != "") & (F.coalesce(first["unit"], F.lit("")) != "") & (F.col("unit") != first["unit"])
    rows = rows.withColumn("rerank", F.round(F.col("below") - F.when(astray, 0.05).otherwise(0.0), 9)).withColumn("role_priority", _of_role("role", 0))
    keys = [
        F.desc(F.round("rerank", 3)), "evidence_priority", F.when(F.col("clamped"), 0).otherwise(1), F.desc(F.when(F.col("clamped"), F.col("pre_ceiling")).otherwise(0.0)),
        "role_priority", F.desc("rerank"), F.desc("combined"), "path", "start_line", "chunk_id",
    ]
    return rows.withColumn("position", F.row_number().over(query.orderBy(*keys)))


def rank_tier() -> Column:
    """0 endpoint found by its signal, 1 related, 2 found by signal or literal text, else 3; one
    lower if only hints of a planner speak for it."""
    planner = _any_part("planner_semantic", "planner_lexical", "planner_path_symbol", "planner_signal", "planner_relation", "graph_seed_planner")
    original = (F.col("token_coverage") > 0) | _any_part("semantic", "lexical", "path_symbol", "signal", "original_relation", "graph_seed_original", "direct_text")
    base = (
        F.when((part("signal") > 0) & F.array_contains("kinds", "endpoint"), 0).when(_any_part("relation", "resolved_relation"), 1)
        .when(_any_part("signal", "direct_text"), 2).otherwise(3)
    )
    return base + (planner & ~original).cast("int")


def anchor_kind(path: Column) -> Column:
    """Files that stand beside the results: readme, risks, pom; null for others."""
    low = F.lower(path)
    return F.when(low.rlike(r"(?:^|/)readme[^/]*\.md$"), "readme").when(low.rlike(r"(?:^|/)risks[^/]*\.md$"), "risks").when(low.rlike(r"(?:^|/)pom\.xml$"), "pom")


def split_results(rows: DataFrame, most: int = 12) -> DataFrame:
    """The ``most`` best paths of each query, and beside them at most ``max(1, min(5, most //
    3))`` anchors: ``query_id, chunk_id, path, kind, place``; of a path the best row counts."""
    kind = F.coalesce(anchor_kind(F.col("path")), F.lit("result"))
    single = rows.withColumn("kind", kind).groupBy("query_id", "path", "kind").agg(F.min(F.struct("position", "chunk_id")).alias("b"))
    anchor = F.col("kind") != "result"
    order = Window.partitionBy("query_id", anchor).orderBy("b.position")
    limit = F.when(anchor, max(1, min(5, most // 3)) if most else 0).otherwise(most)
    return single.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", F.col("b.chunk_id").alias("chunk_id"), "path", "kind", "place")


# How names of implementations and of related types end.
IMPLEMENTATION_NAME = r"^(?:[^.]*(?:service|serviceimpl|impl)\..*|[^.]*(?:service|serviceimpl|impl|executor|exe|gateway|mapper|repository)(?:\..*)?)$"
RELATED_NAME = r"(?:dto|vo|request|response|query|querytype|domain|type|enum|entity|model|bean)$|domain"


def summary_groups(results: DataFrame) -> DataFrame:
    """Per query the sorted distinct names of ``entry_points`` (endpoints, else controllers),
    ``implementation`` (members before types), ``related_types`` and ``possibly_legacy``
    (types beside which nothing else was found), comma-separated. ``results`` has ``query_id,
    path, names, symbols, kinds`` of the chunks shown, which are few per query."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    every = F.array_distinct(F.concat("names", F.array(stem)))
    controller = F.exists(every, lambda n: F.lower(n).rlike("controller$"))
    entry = F.when(F.array_contains("kinds", "endpoint"), F.col("names")).when(controller, F.array(stem)).otherwise(F.array().cast("array<string>"))
    implementing = F.filter(every, lambda n: F.lower(n).rlike(IMPLEMENTATION_NAME))
    members = F.filter(implementing, lambda n: F.contains(n, F.lit(".")))
    related = F.filter(every, lambda n: F.lower(n).rlike(RELATED_NAME))
    rows = results.withColumns({"entry": entry, "impl": F.when(F.size(members) > 0, members).otherwise(implementing), "related": related})
    unused = (F.size("entry") == 0) & (F.size("impl") == 0)
    rows = rows.withColumns({"legacy": F.when(unused, F.col("related")).otherwise(F.array().cast("array<string>")), "kept": F.when(unused, F.array().cast("array<string>")).otherwise(F.col("related"))})
    named = {"entry": "entry_points", "impl": "implementation", "kept": "related_types", "legacy": "possibly_legacy"}
    return rows.groupBy("query_id").agg(*[F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",").alias(name) for c, name in named.items()])
