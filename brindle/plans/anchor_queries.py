"""Queries on probes, anchors, roles, routes and gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import anchors, evaluation, lookup, recall
from brindle.plans import ranking_queries
from brindle.plans.ranking_queries import CAND, CASES, METRICS, PATHS
from brindle.plans.recall_queries import QUERY_TERMS, query_set
from brindle.plans.text_queries import sql_tokens
from brindle.sources.tables import table


def c5_probes(spark: SparkSession, d: str) -> DataFrame:
    """Literal probes of every evaluation prompt."""
    items = table(spark, d, "eval_items").filter(F.col("prompt").isNotNull())
    return items.select("item_id", F.explode(anchors.literal_probes(F.col("prompt"))).alias("probe"))


def c7_signal_scores(spark: SparkSession, d: str) -> DataFrame:
    terms = recall.query_terms(query_set(spark, d))
    signals = table(spark, d, "code_signals")
    return anchors.signal_scores(recall.signal_recall(terms, signals, 24), terms, signals)


def d6_members(spark: SparkSession, d: str) -> DataFrame:
    """Signals that the last part of a qualified target name stands for, where the whole name has none."""
    live = lookup.live(table(spark, d, "code_signals"))
    asked = lookup.live(table(spark, d, "code_relations")).select("target_qualified_name").filter(F.coalesce("target_qualified_name", F.lit("")) != "").distinct()
    loose = asked.join(live.select(F.col("qualified_name").alias("target_qualified_name")).distinct(), "target_qualified_name", "left_anti")
    named = loose.withColumn("name", F.substring_index("target_qualified_name", ".", -1))
    return named.join(live.select("name", "signal_id").distinct(), "name").groupBy("target_qualified_name").agg(F.count("*").alias("signals"))


def d8_scope(spark: SparkSession, d: str) -> DataFrame:
    """Live chunks with their paths and languages."""
    files = table(spark, d, "source_files").select("repo_key", "path", F.lower("language").alias("language"))
    chunks = lookup.live(table(spark, d, "code_signals")).filter(F.col("chunk_id").isNotNull()).select("chunk_id", F.col("file_path").alias("path")).distinct()
    return chunks.join(files, "path", "left").select("repo_key", "chunk_id", "path", "language")


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of direct evidence with their paths."""
    rows = ranking_queries._candidates(spark, d).filter("evidence_class = 'original_direct'").select("query_id", "chunk_id", "score")
    return rows.join(ranking_queries._paths(spark, d).select("chunk_id", "path"), "chunk_id")


def _live_chunks(spark: SparkSession, d: str) -> DataFrame:
    return lookup.live(table(spark, d, "code_signals")).filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min("file_path").alias("path"))


def e1_same_file(spark: SparkSession, d: str) -> DataFrame:
    return anchors.file_neighbours(_anchors(spark, d), _live_chunks(spark, d), 36)


def e2_same_directory(spark: SparkSession, d: str) -> DataFrame:
    return anchors.directory_neighbours(_anchors(spark, d), _live_chunks(spark, d), 36)


def e7_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Signals imported exactly from files of anchors."""
    rel = lookup.live(table(spark, d, "code_relations")).filter((F.col("resolution") == "resolved_exact") & F.col("kind").isin("imports", "imports_type"))
    imported = rel.select(F.col("source_chunk_id").alias("chunk_id"), "target_signal_id").dropna().distinct()
    return _anchors(spark, d).join(imported, "chunk_id").groupBy("query_id", "target_signal_id").agg(F.count("*").alias("anchors"))


def f7_chunk_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = lookup.live(table(spark, d, "code_signals")).filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.collect_set("kind").alias("kinds"), F.min("file_path").alias("path"))
    return rows.groupBy(anchors.chunk_role(F.col("kinds"), F.col("path")).alias("role")).agg(F.count("*").alias("chunks"))


def f18_routes(spark: SparkSession, d: str) -> DataFrame:
    """Qualified names of endpoints and routes as routes, against the first one of their
    project unit."""
    signals = lookup.live(table(spark, d, "code_signals")).filter(F.col("kind").isin("endpoint", "route") & (F.coalesce("qualified_name", F.lit("")) != ""))
    routes = signals.select("project_unit_key", "signal_id", F.concat(F.lit("/"), F.replace("qualified_name", F.lit("."), F.lit("/"))).alias("route")).distinct()
    first = routes.groupBy("project_unit_key").agg(F.min("route").alias("wanted"))
    return routes.join(first, "project_unit_key").select("signal_id", "route", anchors.route_score(F.col("wanted"), F.col("route")).alias("score"))


def f23_bonus(spark: SparkSession, d: str) -> DataFrame:
    """The one candidate of each query that a bonus for exact imports goes to."""
    rows = ranking_queries._candidates(spark, d).select("query_id", "chunk_id", "rerank_score")
    imported = lookup.live(table(spark, d, "code_relations")).filter(F.col("resolution") == "resolved_exact").select(F.col("source_chunk_id").alias("chunk_id")).dropna().distinct()
    from brindle.operators.ranking import ordered

    best = ordered(rows.join(imported, "chunk_id", "left_semi"), "query_id", [F.desc("rerank_score"), "chunk_id"]).filter("position = 1")
    return best.select("query_id", "chunk_id", F.round(F.col("rerank_score") + 0.04, 6).alias("rerank_score"))


def b19_modules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").filter(F.endswith("path", F.lit(".py"))).select("file_id", anchors.python_module(F.col("path")).alias("module"))


def f34_variants(spark: SparkSession, d: str) -> DataFrame:
    return query_set(spark, d).select("query_id", F.posexplode(anchors.query_variants(F.col("query_text"))).alias("variant", "text"))


def f36_profiles(spark: SparkSession, d: str) -> DataFrame:
    return anchors.repository_profile(table(spark, d, "source_files"), table(spark, d, "code_signals"))


METRIC_NAMES = ["reciprocal_rank", "recall_5", "recall_10", "precision_5"]


def h12_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics of the order by plain score and of the final order, and the difference."""
    return evaluation.metric_deltas(ranking_queries._plain_cases(spark, d), ranking_queries._cases(spark, d), METRIC_NAMES)


def h14_gates(spark: SparkSession, d: str) -> DataFrame:
    """Cases by gate and outcome at 5. A query with direct evidence for some candidate has to
    be answered, one with weak evidence only is a known gap, others inform."""
    best = ranking_queries._candidates(spark, d).groupBy("query_id").agg(F.min("evidence_priority").alias("best"))
    cases = ranking_queries._cases(spark, d).join(best, "query_id")
    gate = F.when(F.col("best") == 0, "required").when(F.col("best") == 1, "known_gap").otherwise("informational")
    return cases.groupBy(gate.alias("gate"), evaluation.case_status(gate, ~F.col("hit_5")).alias("status")).agg(F.count("*").alias("cases"))


QUERIES = {f.__name__: f for f in (c5_probes, c7_signal_scores, d6_members, d8_scope, e1_same_file, e2_same_directory, e7_provenance, f7_chunk_roles, f18_routes, f23_bonus, b19_modules, f34_variants, f36_profiles, h12_deltas, h14_gates)}

LIVE = "live AS (SELECT * FROM code_signals WHERE deleted_at IS NULL), rel AS (SELECT * FROM code_relations WHERE deleted_at IS NULL)"
ANCHORS = f"{CAND}, {PATHS}, alive AS (SELECT chunk_id, min(file_path) AS path FROM code_signals WHERE chunk_id IS NOT NULL AND deleted_at IS NULL GROUP BY ALL), anchors AS (SELECT query_id, chunk_id, score, path FROM cand JOIN paths USING (chunk_id) WHERE evidence_class = 'original_direct')"
FOLDER = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
LOOSE = r"regexp_matches(path, '\.(md|ya?ml|json|xml|properties)$')"

ORACLES = {
    "c5_probes": f"""WITH p AS (SELECT item_id, trim(prompt) AS t FROM eval_items WHERE prompt IS NOT NULL),
e AS (SELECT item_id, list_distinct(list_filter(flatten([[t], regexp_split_to_array(t, '\\s+'), regexp_extract_all(t, '[A-Za-z0-9_./:@-]{{3,}}'), list_filter({sql_tokens('t')}, lambda x: length(x) >= 3 OR regexp_matches(x, '[\\x{{3400}}-\\x{{9fff}}]'))]), lambda x: x <> '')) AS every FROM p),
u AS (SELECT item_id, len(every) AS n, unnest(every) AS probe FROM e) SELECT item_id, probe FROM u QUALIFY n <= 30 OR row_number() OVER (PARTITION BY item_id ORDER BY length(probe) DESC, probe) <= 30""",
    "c7_signal_scores": f"""WITH {QUERY_TERMS}, live AS (SELECT DISTINCT ON (signal_id) signal_id, kind, start_line, end_line, name, lower(file_path) AS path, recallable, lower(concat_ws(' ', name, array_to_string(coalesce(tokens, []::VARCHAR[]), ' '))) AS hay,
  lower(concat_ws(' ', name, array_to_string(coalesce(tokens, []::VARCHAR[]), ' '), array_to_string(list_concat(map_keys(metadata), map_values(metadata)), ' '))) AS wide FROM code_signals WHERE deleted_at IS NULL),
n AS (SELECT query_id, signal_id, count(*) AS hits FROM terms JOIN live ON contains(wide, term) WHERE recallable GROUP BY ALL),
h AS (SELECT query_id, signal_id FROM n JOIN live USING (signal_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, CASE WHEN kind = 'endpoint' THEN 0 ELSE 1 END, start_line, end_line, kind, name, signal_id) <= 24)
SELECT query_id, signal_id, round(sum(CASE WHEN contains(hay, term) THEN 1.0::DOUBLE WHEN contains(path, term) THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END) / count(*), 6) AS score FROM h JOIN live USING (signal_id) JOIN terms USING (query_id) GROUP BY ALL""",
    "d6_members": f"WITH {LIVE}, a AS (SELECT DISTINCT target_qualified_name AS q FROM rel WHERE coalesce(target_qualified_name, '') <> ''), l AS (SELECT q, string_split(q, '.')[-1] AS name FROM a WHERE q NOT IN (SELECT qualified_name FROM live WHERE qualified_name IS NOT NULL)) SELECT q AS target_qualified_name, count(DISTINCT signal_id) AS signals FROM l JOIN live USING (name) GROUP BY ALL",
    "d8_scope": f"WITH {LIVE}, f AS (SELECT repo_key, path, lower(language) AS language FROM source_files) SELECT DISTINCT f.repo_key, chunk_id, file_path AS path, f.language FROM live LEFT JOIN f ON f.path = file_path WHERE chunk_id IS NOT NULL",
    "e1_same_file": f"WITH {ANCHORS}, n AS (SELECT a.query_id, p.chunk_id, round(max(a.score) * 0.80::DOUBLE, 6) AS score FROM anchors a JOIN alive p USING (path) WHERE NOT EXISTS (SELECT 1 FROM anchors x WHERE x.query_id = a.query_id AND x.chunk_id = p.chunk_id) GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 36",
    "e2_same_directory": f"WITH {ANCHORS}, l AS (SELECT query_id, score, {FOLDER} AS folder FROM anchors WHERE {LOOSE}), c AS (SELECT chunk_id, {FOLDER} AS folder FROM alive WHERE NOT {LOOSE}), n AS (SELECT l.query_id, c.chunk_id, round(max(l.score) * 0.55::DOUBLE, 6) AS score FROM l JOIN c USING (folder) WHERE NOT EXISTS (SELECT 1 FROM anchors x WHERE x.query_id = l.query_id AND x.chunk_id = c.chunk_id) GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 36",
    "e7_provenance": f"WITH {ANCHORS}, {LIVE}, i AS (SELECT DISTINCT source_chunk_id AS chunk_id, target_signal_id FROM rel WHERE resolution = 'resolved_exact' AND kind IN ('imports', 'imports_type') AND source_chunk_id IS NOT NULL AND target_signal_id IS NOT NULL) SELECT query_id, target_signal_id, count(*) AS anchors FROM anchors JOIN i USING (chunk_id) GROUP BY ALL",
    "f7_chunk_roles": rf"WITH {LIVE}, c AS (SELECT chunk_id, list(DISTINCT kind) AS k, min(file_path) AS path FROM live WHERE chunk_id IS NOT NULL GROUP BY ALL) SELECT CASE WHEN list_contains(k, 'endpoint') OR list_contains(k, 'route') THEN 'entrypoint' WHEN regexp_matches(path, '(Impl|Service)\.java$') THEN 'service_impl' WHEN regexp_matches(path, '(Executor|Worker|Handler|Job)\.[a-z]+$') THEN 'executor' WHEN list_contains(k, 'mybatis_statement') THEN 'data_access' WHEN list_contains(k, 'type') AND NOT list_contains(k, 'method') AND NOT list_contains(k, 'function') THEN 'data_type' ELSE 'other' END AS role, count(*) AS chunks FROM c GROUP BY ALL",
    "f18_routes": f"WITH {LIVE}, f AS (SELECT DISTINCT project_unit_key, signal_id, '/' || replace(qualified_name, '.', '/') AS route, rtrim(lower('/' || replace(qualified_name, '.', '/')), '/') AS r FROM live WHERE kind IN ('endpoint', 'route') AND coalesce(qualified_name, '') <> ''), w AS (SELECT project_unit_key, rtrim(lower(min(route)), '/') AS w FROM f GROUP BY ALL) SELECT signal_id, route, CASE WHEN w = r THEN 0.35::DOUBLE WHEN starts_with(r, w || '/') OR starts_with(w, r || '/') THEN 0.12::DOUBLE WHEN regexp_replace(w, '/[^/]*$', '') = regexp_replace(r, '/[^/]*$', '') THEN -0.18::DOUBLE ELSE -0.30::DOUBLE END AS score FROM f JOIN w USING (project_unit_key)",
    "f23_bonus": f"WITH {CAND}, {LIVE} SELECT query_id, chunk_id, round(rerank_score + 0.04::DOUBLE, 6) AS rerank_score FROM cand WHERE chunk_id IN (SELECT source_chunk_id FROM rel WHERE resolution = 'resolved_exact') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cand.rerank_score DESC, chunk_id) = 1",
    "b19_modules": r"SELECT file_id, replace(regexp_replace(regexp_replace(regexp_replace(path, '\.py$', ''), '(^|/)__init__$', ''), '^(src|lib)/', ''), '/', '.') AS module FROM source_files WHERE ends_with(path, '.py')",
    "f36_profiles": f"""WITH {LIVE}, s AS (SELECT file_path AS path, count(DISTINCT name) AS symbols FROM live GROUP BY ALL), lc AS (SELECT repo_key, lower(language) AS language, count(*) AS n FROM source_files WHERE language IS NOT NULL GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY n DESC, language) AS p FROM lc QUALIFY p <= 5), fr AS (SELECT repo_key, path, row_number() OVER (PARTITION BY repo_key ORDER BY coalesce(is_generated, false), coalesce(is_test, false), coalesce(symbols, 0) DESC, length(path), path) AS p FROM source_files LEFT JOIN s USING (path) QUALIFY p <= 3),
l AS (SELECT repo_key, string_agg(language, ',' ORDER BY p) AS languages FROM lr GROUP BY ALL), f AS (SELECT repo_key, string_agg(path, ',' ORDER BY p) AS files FROM fr GROUP BY ALL) SELECT repo_key, languages, files FROM l FULL JOIN f USING (repo_key)""",
    "h12_deltas": CASES + f""", plain AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position, evidence_class = 'original_direct' AS relevant, evidence_class = 'weak_or_generic' AS noise FROM cand), before AS (SELECT query_id, {METRICS} FROM plain GROUP BY query_id),
m AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS side, '{m}' AS metric, round({m} * 1000000)::BIGINT AS v FROM {t}" for m in METRIC_NAMES for t in ("before", "cases")) + """),
a AS (SELECT metric, (sum(v) FILTER (side = 'before'))::BIGINT / (count(*) FILTER (side = 'before'))::DOUBLE / 1e6::DOUBLE AS b, (sum(v) FILTER (side = 'cases'))::BIGINT / (count(*) FILTER (side = 'cases'))::DOUBLE / 1e6::DOUBLE AS a FROM m GROUP BY ALL) SELECT metric, round(b, 5) AS before, round(a, 5) AS after, round(a - b, 5) AS delta FROM a""",
    "h14_gates": CASES + ", best AS (SELECT query_id, min(evidence_priority) AS best FROM cand GROUP BY ALL), g AS (SELECT hit_5, CASE best WHEN 0 THEN 'required' WHEN 1 THEN 'known_gap' ELSE 'informational' END AS gate FROM cases JOIN best USING (query_id)) SELECT gate, CASE WHEN hit_5 THEN CASE WHEN gate = 'known_gap' THEN 'unexpected_pass' ELSE 'pass' END WHEN gate = 'required' THEN 'fail' WHEN gate = 'known_gap' THEN 'expected_gap' ELSE 'info' END AS status, count(*) AS cases FROM g GROUP BY ALL",
    "f34_variants": f"""WITH queries AS (SELECT DISTINCT query_id, query_text FROM ranked_chunks), t AS (SELECT query_id, query_text, {sql_tokens('query_text')} AS raw FROM queries),
d AS (SELECT query_id, query_text, list_filter(list_transform(raw, lambda x: lower(x)), lambda x, i: list_position(list_transform(raw, lambda y: lower(y)), x) = i) AS tokens FROM t),
f AS (SELECT query_id, list_transform([trim(query_text), array_to_string(tokens, ' '), array_to_string(list_filter(tokens, lambda x: length(x) >= 4), ' ')], lambda x: lower(trim(x))[1:256]) AS forms FROM d),
k AS (SELECT query_id, list_filter(forms, lambda x, i: x <> '' AND list_position(forms, x) = i) AS kept FROM f)
SELECT query_id, (unnest(range(1, len(kept) + 1)) - 1)::INT AS variant, unnest(kept) AS text FROM k""",
}
