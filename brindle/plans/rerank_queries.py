"""Queries on query understanding and the rerank score, with their SQL. A candidate's chunk
is what the signals of its chunk id say, with the lines of their file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import distinct_lower, identifier_tokens, text_lines
from brindle.operators import conventions, extract, frontend, graph, intent, refresh, rerank
from brindle.operators.lookup import chunks_for_ids, live
from brindle.plans.index_queries import LATEST
from brindle.plans.text_queries import sql_lines, sql_tokens
from brindle.sources import trees
from brindle.sources.tables import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").join(table(spark, d, "file_texts"), "file_id", "left")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of live signals; a path that several repositories have is that of the least id."""
    signals = live(table(spark, d, "code_signals")).filter(F.col("chunk_id").isNotNull())
    symbols = F.array_sort(F.collect_set(F.when(F.col("name").isNotNull(), F.struct("name", "start_line"))))
    held = signals.groupBy("chunk_id").agg(
        F.min("file_path").alias("path"), symbols.alias("symbols"), F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("tokens"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("project_unit_key").alias("unit"),
    )
    files = _files(spark, d).groupBy("path").agg(F.min(F.struct("file_id", "content", "is_test", "is_generated")).alias("f")).select("path", "f.content", "f.is_test", "f.is_generated")
    lines = F.array_join(F.slice(text_lines(F.col("content")), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    joined = held.join(files, "path", "left").withColumn("names", F.array_distinct(F.transform("symbols", lambda s: s["name"])))
    return joined.withColumn("content", F.when(F.col("start_line") >= 1, lines))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    return rerank.rerank(table(spark, d, "ranked_chunks"), _chunks(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ranked_chunks").select("query_id", "query_text").distinct()
    return rows.withColumn("query_tokens", distinct_lower(identifier_tokens(F.col("query_text"))))


def f12_path_roles(spark: SparkSession, d: str) -> DataFrame:
    role = intent.path_role(F.col("path"), F.col("content"))
    return _files(spark, d).select("file_id", role.alias("r")).select("file_id", F.col("r.name").alias("role"), F.col("r.priority").alias("priority"))


def f14_intents(spark: SparkSession, d: str) -> DataFrame:
    named = intent.with_query_intent(_texts(spark, d))
    return named.select("query_id", *[F.array_join(c, ",").alias(c) for c in ("operations", "targets", "artifacts")], "wants_artifact", "confidence")


def f14_document_intents(spark: SparkSession, d: str) -> DataFrame:
    """The same over the texts of documents, which are in many languages and scripts."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("query_text")).withColumn("query_tokens", F.array().cast("array<string>"))
    named = intent.with_query_intent(rows)
    return named.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("operations", "targets", "artifacts")], "wants_artifact", "confidence")


def f15_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers and hints in queries and in the messages about files."""
    rows = table(spark, d, "source_files").select("file_id", F.concat_ws(" ", F.lit("why does"), F.substring_index("path", "/", -1), F.lit("fail in the service"), F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1)).alias("query_text"))
    named = intent.with_identifiers(rows.withColumn("query_tokens", distinct_lower(identifier_tokens(F.col("query_text")))))
    return named.select("file_id", *[F.array_join(c, ",").alias(c) for c in ("identifiers", "file_hints", "suffix_hints")], F.array_join(F.array_sort("role_hints"), ",").alias("role_hints"), "exact_identifier")


def f11_noise(spark: SparkSession, d: str) -> DataFrame:
    """What each file is to a query for logic, with its penalty and boost."""
    rows = table(spark, d, "source_files").select("file_id", "path", "is_test", "is_generated").withColumns({"query_text": F.lit("where is the upload handler"), "query_tokens": F.array(*[F.lit(w) for w in "where is the upload handler".split()])})
    return rerank.with_noise(rows).select("file_id", "file_role", "noise", "source_boost", "lockfile_asked")


def f6_rerank(spark: SparkSession, d: str) -> DataFrame:
    return reranked(spark, d).select("query_id", "chunk_id", F.round("combined", 6).alias("combined"), F.round("pre_ceiling", 6).alias("pre_ceiling"), F.round("rerank", 6).alias("rerank"), "evidence_class", "clamped")


def f6_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the score that come from roles and intents."""
    rows = reranked(spark, d)
    return rows.select("query_id", "chunk_id", F.col("path_role.name").alias("path_role"), "role", "file_role", F.round("token_coverage", 6).alias("token_coverage"), "penalty", "demotion", F.round("identifier_boost", 6).alias("identifier_boost"), "owner_boost", "role_hint_boost", "role_mismatch", F.round("intent_boost", 6).alias("intent_boost"))


def f10_reranked_order(spark: SparkSession, d: str) -> DataFrame:
    """The total order by all ten keys over the computed score."""
    return reranked(spark, d).select("query_id", "chunk_id", "position")


def f26_rank_tiers(spark: SparkSession, d: str) -> DataFrame:
    return reranked(spark, d).select("query_id", "chunk_id", rerank.rank_tier().alias("tier"))


def f30_split(spark: SparkSession, d: str) -> DataFrame:
    """Twelve results per query and the anchors beside them."""
    return rerank.split_results(reranked(spark, d)).select("query_id", "chunk_id", "path", "kind", "place")


def f5_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence classes from the parts and the coverage, counted beside the recorded ones."""
    recorded = table(spark, d, "ranked_chunks").groupBy("query_id", "chunk_id").agg(F.min("evidence_class").alias("recorded"))
    rows = reranked(spark, d).select("query_id", "chunk_id", "evidence_class", "evidence_priority").join(recorded, ["query_id", "chunk_id"])
    return rows.groupBy("recorded", "evidence_class").agg(F.count("*").alias("candidates"), F.max("evidence_priority").alias("priority"))


def f32_summary(spark: SparkSession, d: str) -> DataFrame:
    """Names of entry points, implementations, related types and possibly unused types among
    the results of each query."""
    results = rerank.split_results(reranked(spark, d)).filter("kind = 'result'").select("query_id", "chunk_id")
    return rerank.summary_groups(results.join(_chunks(spark, d), "chunk_id"))


def g1_pack_items(spark: SparkSession, d: str) -> DataFrame:
    """Results with their lines as items of an evidence pack of 16,384 bytes, best first."""
    results = rerank.split_results(reranked(spark, d)).filter("kind = 'result'")
    sized = results.join(_chunks(spark, d).select("chunk_id", F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("bytes")), "chunk_id")
    order = rerank.Window.partitionBy("query_id").orderBy("place").rowsBetween(rerank.Window.unboundedPreceding, 0)
    return sized.withColumn("total", F.sum("bytes").over(order)).filter(F.col("total") <= 16_384).select("query_id", "path", "chunk_id", "place", "bytes", "total")


def d1_ordered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the candidates of each query in the order of their recorded scores."""
    rows = table(spark, d, "ranked_chunks").filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    wanted = rows.select("query_id", "chunk_id", F.row_number().over(rerank.Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).alias("place"))
    spans = live(table(spark, d, "code_signals")).filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min("file_path").alias("path"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return chunks_for_ids(wanted, spans).select("query_id", "place", "chunk_id", "path", "start_line", "end_line")


def a19_packs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each query in that order as one JSON text of at most 2,048 bytes."""
    return trees.packed_json(d1_ordered_chunks(spark, d).select("query_id", "place", "chunk_id", "path"), "query_id", "place", 2048)


def i10_status(spark: SparkSession, d: str) -> DataFrame:
    """State of each repository's files against its last observations, and of its last run."""
    moved = refresh.snapshot_diff(refresh.latest_snapshot(table(spark, d, "source_observations")), table(spark, d, "source_files"))
    counts = moved.groupBy("repo_key").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("added", "deleted", "changed", "touched", "unchanged")])
    runs = table(spark, d, "index_runs").groupBy("repo_key").agg(F.max(F.struct("started_at", "run_id", "status"))["status"].alias("last_status"), F.max(F.when(F.col("status") == "succeeded", F.col("generation"))).alias("generation"))
    return counts.join(runs, "repo_key", "full_outer")


def e3_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of the graph: candidates found by a path or symbol count as signals here, since
    the recorded parts name no signals."""
    rows = table(spark, d, "ranked_chunks").dropDuplicates(["query_id", "chunk_id"])
    parts = F.map_filter(F.transform_keys("score_parts", lambda k, v: F.when(k == "path_symbol", "signal").when(k == "semantic", "planner_signal").otherwise(k)), lambda k, v: v.isNotNull() & ~F.isnan(v))
    seeds = graph.relation_seeds(rows.withColumn("score_parts", parts))
    return seeds.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "source", "priority")


def f19_context(spark: SparkSession, d: str) -> DataFrame:
    """What members of Java chunks have in common with the query of their candidate."""
    rows = reranked(spark, d).select("query_id", "chunk_id", "path", "role", "query_tokens")
    signals = live(table(spark, d, "code_signals")).select("chunk_id", "kind", "tokens").dropna(subset=["chunk_id"])
    return frontend.java_context(rows.join(signals, "chunk_id"))


def f22_frontend_roles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", frontend.frontend_role(F.col("path")).alias("role"))


def f22_frontend_parts(spark: SparkSession, d: str) -> DataFrame:
    """What frontend files are to the query of their candidate, where that is anything."""
    rows = frontend.with_frontend_parts(reranked(spark, d).select("query_id", "chunk_id", "query_text", "path"))
    some = (F.col("entrypoint_boost") > 0) | (F.col("support_boost") > 0) | (F.col("support_name_boost") > 0) | (F.col("frontend_penalty") < 0)
    return rows.filter(some).select("query_id", "chunk_id", "frontend_role", *[F.round(c, 6).alias(c) for c in ("entrypoint_boost", "support_boost", "support_name_boost", "frontend_penalty")])


def e11_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Supporting files lifted by the pages and components that import them."""
    texts = table(spark, d, "source_files").select("file_id", "path").join(table(spark, d, "file_texts"), "file_id").select("path", "content")
    imports = extract.resolved_imports(extract.facts(texts), texts).select(F.col("path").alias("source_path"), F.col("target").alias("target_path"))
    return frontend.import_cohorts(reranked(spark, d), imports).select("query_id", "chunk_id", F.round("rerank", 6).alias("rerank"), F.round("boosted", 6).alias("boosted"))


def e10_test_targets(spark: SparkSession, d: str) -> DataFrame:
    """Tests and the file their convention leads to; a unit is a top directory."""
    files = table(spark, d, "source_files").select("repo_key", F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("").alias("unit"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), "is_test", "is_generated")
    return conventions.test_targets(files)


def a6_test_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files that are tests by their path, and what their tests could be about."""
    inner = F.regexp_replace("path", "^[^/]*/", "")
    return table(spark, d, "source_files").select("file_id", conventions.is_test_path(inner).alias("is_test_path"), F.array_join(conventions.production_candidates(inner), ",").alias("candidates"))


def _sql_role() -> str:
    """The rules of paths as a CASE over low, path and code."""
    whens = " ".join(f"WHEN {' AND '.join(f'regexp_matches({which}, {_quoted(pattern)})' for which, pattern in patterns)} THEN {{'name': '{name}', 'priority': {priority}}}" for name, priority, patterns in intent.PATH_RULES)
    return f"CASE {whens} ELSE {{'name': '{intent.OTHER_ROLE[0]}', 'priority': {intent.OTHER_ROLE[1]}}} END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_groups(groups: dict[str, str], raw: str, words: str) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {_sql_says(keywords, raw, words)} THEN '{name}' END" for name, keywords in groups.items()) + "], lambda x: x IS NOT NULL))"


def _sql_says(keywords: str, raw: str, words: str) -> str:
    plain = [w for w in keywords.split() if w.isascii()]
    others = [w for w in keywords.split() if not w.isascii()]
    return "(" + " OR ".join([f"list_has_any({words}, {plain})", *[f"contains({raw}, '{w}')" for w in others]]) + ")"


def _sql_intents(source: str, key: str, tokens: str) -> str:
    """Common tables up to ``intents`` over ``source(key, query_text)``."""
    return f"""worded AS (SELECT {key}, lower(coalesce(query_text, '')) AS raw, list_concat({tokens}, regexp_extract_all(lower(coalesce(query_text, '')), '[a-z0-9_]+')) AS words FROM {source}),
grouped AS (SELECT {key}, raw, words, {_sql_groups(intent.OPERATIONS, 'raw', 'words')} AS operations, {_sql_groups(intent.TARGETS, 'raw', 'words')} AS targets, {_sql_groups(intent.ARTIFACTS, 'raw', 'words')} AS artifacts FROM worded),
wanted AS (SELECT *, len(artifacts) > 0 AND ({_sql_says(intent.ARTIFACT_HINTS, 'raw', 'words')} OR list_has_any(targets, ['deploy', 'doc', 'test'])) AS wants_artifact FROM grouped),
intents AS (SELECT *, (len(operations) + len(targets) + wants_artifact::INT)::INT AS confidence FROM wanted)"""


TOKENS = f"list_distinct(list_transform({sql_tokens('query_text')}, lambda x: lower(x)))"
QUERY_TEXTS = "q AS (SELECT DISTINCT query_id, query_text FROM ranked_chunks)"
FILES = f"files AS (SELECT s.*, content, lower(coalesce(path, '')) AS low, regexp_replace(coalesce(content, ''), {_quoted(intent.NO_CODE)}, ' ', 'g') AS code FROM source_files s LEFT JOIN file_texts USING (file_id))"
HINT_MAP = "MAP {" + ", ".join(f"'{word}': '{role}'" for role, words in intent.ROLE_HINTS.items() for word in words.split()) + "}"


def _sql_identifiers(source: str, key: str, tokens: str) -> str:
    """Common table ``hinted`` over ``source(key, query_text)``."""
    return rf"""plain AS (SELECT {key}, coalesce(query_text, '') AS query_text, regexp_replace(coalesce(query_text, ''), '[^\x00-\x7F]', '__', 'g') AS ascii_text, {tokens} AS query_tokens FROM {source}),
named AS (SELECT *, list_sort(list_distinct(list_concat(regexp_extract_all(ascii_text, '\b(?:{intent.CAMEL})\b'), regexp_extract_all(ascii_text, '\b{intent.SNAKE}\b')))) AS identifiers,
  list_transform(list_filter(regexp_extract_all(query_text, '[\p{{L}}\p{{N}}_.-]+'), lambda r: regexp_full_match(r, '[\p{{L}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{N}}_-]+)+')), lambda r: lower(r)) AS hints,
  list_filter(list_transform(list_concat(query_tokens, regexp_extract_all(query_text, '[A-Za-z0-9_+-]+')), lambda t: {HINT_MAP}[lower(t)]), lambda x: x IS NOT NULL) AS roles FROM plain),
hinted AS (SELECT * EXCLUDE (hints, roles), list_filter(hints, lambda x, i: list_position(hints, x) = i) AS file_hints, list_sort(list_distinct(roles)) AS role_hints,
  CASE WHEN regexp_full_match(trim(query_text), '{intent.CAMEL}|{intent.SNAKE}|{intent.SCREAMING}') THEN trim(query_text) END AS exact_identifier FROM named)"""


def _sql_list(words: str) -> str:
    return str(words.split())


NOISE = rf"""roled AS (SELECT *, regexp_matches(low, '{rerank.TEST}') OR coalesce(is_test, false) AS t, regexp_matches(low, '{rerank.GENERATED}') OR coalesce(is_generated, false) AS g, regexp_matches(low, '{rerank.LOCKFILE}') AS l,
  contains(query_text, '/') OR list_has_any(query_tokens, {_sql_list(rerank.IMPLEMENTATION_WORDS)}) AS logic,
  list_has_any(query_tokens, {_sql_list(rerank.LOCK_WORDS)}) OR (regexp_matches(low, '(?:^|/)go\.sum$') AND (list_contains(query_tokens, 'gosum') OR list_has_all(query_tokens, ['go', 'sum']))) AS lock_asked FROM noisy),
filed AS (SELECT *, CASE WHEN t THEN 'test' WHEN g THEN 'generated_schema' WHEN l THEN 'lockfile' WHEN regexp_matches(low, '{rerank.TEMPLATE}') THEN CASE WHEN regexp_matches(low, '(?:^|/)(?:views?|pages?|layouts?|components?)/') THEN 'source' ELSE 'template' END
  WHEN regexp_matches(low, '{rerank.DOC}') THEN 'doc' WHEN regexp_matches(low, '{rerank.CONFIG}') THEN 'config' WHEN regexp_matches(low, '{rerank.SOURCE}') THEN 'source' ELSE 'unknown' END AS file_role FROM roled),
judged AS (SELECT *, least(CASE WHEN g OR contains(low, 'generated') THEN -0.20::DOUBLE ELSE 0 END, CASE WHEN t THEN -0.10::DOUBLE ELSE 0 END, CASE WHEN l AND NOT lock_asked THEN -0.20::DOUBLE ELSE 0 END,
  CASE WHEN logic AND file_role = 'template' THEN -0.08::DOUBLE WHEN logic AND file_role IN ('doc', 'config') THEN -0.03::DOUBLE ELSE 0 END) AS noise, CASE WHEN file_role = 'source' THEN 0.03::DOUBLE ELSE 0 END AS source_boost, l AND lock_asked AS lockfile_asked FROM filed)"""


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _map(values: dict, at: int | None = None) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v if at is None else v[at]}::DOUBLE" for k, v in values.items()) + "}"


def _p(key: str) -> str:
    return f"coalesce(CASE WHEN NOT isnan(score_parts['{key}']) THEN score_parts['{key}'] END, 0.0)::DOUBLE"


RERANKED = rf"""WITH {QUERY_TEXTS}, {_sql_intents('q', 'query_id', TOKENS)}, {_sql_identifiers('q', 'query_id', TOKENS)}, {FILES},
one AS (SELECT path, min(file_id) AS file_id FROM files GROUP BY path),
single AS (SELECT f.* FROM files f JOIN one USING (path, file_id)),
held AS (SELECT chunk_id, min(file_path) AS path, list_sort(list_distinct(list({{'name': name, 'start_line': start_line}}) FILTER (name IS NOT NULL))) AS symbols, list_distinct(list(kind)) AS kinds, list_distinct(flatten(list(tokens) FILTER (tokens IS NOT NULL))) AS tokens,
  min(start_line) AS start_line, max(end_line) AS end_line, min(project_unit_key) AS unit FROM code_signals WHERE deleted_at IS NULL AND chunk_id IS NOT NULL GROUP BY chunk_id),
chunks AS (SELECT h.* EXCLUDE (symbols), coalesce(symbols, []) AS symbols, list_distinct(list_transform(coalesce(symbols, []), lambda s: s.name)) AS names, is_test, is_generated,
  CASE WHEN start_line >= 1 THEN array_to_string({sql_lines('content')}[start_line:end_line], chr(10)) END AS content FROM held h LEFT JOIN single USING (path)),
coded AS (SELECT *, lower(coalesce(path, '')) AS low, lower(coalesce(content, '')) AS text, lower(array_to_string(names, ' ')) AS named, regexp_replace(coalesce(content, ''), {_quoted(intent.NO_CODE)}, ' ', 'g') AS code,
  regexp_replace(list_last(string_split(lower(path), '/')), '\.[^.]+$', '') AS stem FROM chunks),
known AS (SELECT *, {_sql_role()} AS pr, CASE WHEN regexp_matches(low, '{rerank.TEST}') THEN 'generic' WHEN contains(low || ' ' || named, 'controller') THEN 'entrypoint' WHEN contains(low, '/service/impl/') OR contains(low || ' ' || named, 'serviceimpl') THEN 'service_impl'
  WHEN regexp_matches(stem, '(?:executor|exe)$') OR len(list_filter(names, lambda n: regexp_matches(lower(n), '(?:executor|exe)$'))) > 0 THEN 'executor' WHEN regexp_matches(low, '/(?:dto|vo|query|entity)/') THEN 'data_type'
  WHEN contains(low, '/service/') AND contains(text, 'interface ') THEN 'service_interface' WHEN contains(low, '/service/') THEN 'service' WHEN regexp_matches(low, '/mappers?/') OR contains(named, 'mapper') THEN 'mapper'
  WHEN regexp_matches(low || ' ' || named || ' ' || text, 'handler|listener|callback|connector|webhook') THEN 'handler' WHEN regexp_matches(low || ' ' || named || ' ' || text, 'constant|config|buildermanager|parambuilder') THEN 'constant_or_config' ELSE 'generic' END AS role,
  list_concat(list_transform(coalesce(tokens, []), lambda t: lower(t)), list_transform({sql_tokens('content')}, lambda t: lower(t))) AS have FROM coded),
cand AS (SELECT DISTINCT ON (query_id, chunk_id) query_id, chunk_id, score_parts FROM ranked_chunks),
noisy AS (SELECT c.*, h.query_text, h.query_tokens, h.identifiers, h.file_hints, h.role_hints, h.exact_identifier, i.operations, i.targets, i.artifacts, i.wants_artifact, k.* EXCLUDE (chunk_id),
  CASE WHEN len(h.query_tokens) > 0 THEN len(list_filter(h.query_tokens, lambda t: list_contains(k.have, t))) / len(h.query_tokens)::DOUBLE ELSE 0 END AS token_coverage
  FROM cand c JOIN known k USING (chunk_id) JOIN hinted h USING (query_id) JOIN intents i USING (query_id)),
{NOISE},
asked AS (SELECT *, list_distinct(list_filter(list_append(identifiers, exact_identifier), lambda x: x IS NOT NULL)) AS wanted_names FROM judged),
matched AS (SELECT *, len(list_filter(wanted_names, lambda i: list_contains(list_transform(names, lambda n: lower(n)), lower(i)) OR lower(i) = stem OR contains(low, lower(i)))) AS in_name,
  len(list_filter(wanted_names, lambda i: NOT (list_contains(list_transform(names, lambda n: lower(n)), lower(i)) OR lower(i) = stem OR contains(low, lower(i))) AND contains(text, lower(i)))) AS in_text,
  len(list_filter(file_hints, lambda h: contains(low, h))) > 0 AS file_hint, len(list_filter(file_hints, lambda h: contains(text, h))) > 0 AS said_hint FROM asked),
boosted AS (SELECT *, least(0.40::DOUBLE, greatest(CASE WHEN file_hint THEN 0.40::DOUBLE WHEN said_hint THEN 0.30 ELSE 0 END, CASE WHEN in_name > 0 THEN 0.30::DOUBLE WHEN in_text > 0 THEN 0.20 ELSE 0 END)
  + CASE WHEN in_name + in_text > 2 THEN least(0.15::DOUBLE, 0.05::DOUBLE * (in_name + in_text - 1) + 0.05) WHEN in_name + in_text > 1 THEN 0.05::DOUBLE ELSE 0 END) AS identifier_boost,
  CASE WHEN len(list_filter(symbols, lambda s: s.name = exact_identifier AND s.start_line BETWEEN start_line AND end_line)) > 0 THEN 0.50::DOUBLE ELSE 0 END AS owner_boost,
  list_contains(role_hints, pr.name) OR (pr.name IN ('service_impl', 'service_interface') AND list_contains(role_hints, 'service')) AS fits FROM matched),
hints2 AS (SELECT *, CASE WHEN fits AND pr.name = 'service_interface' THEN 0.08::DOUBLE WHEN fits THEN 0.14 ELSE 0 END AS role_hint_boost, CASE WHEN identifier_boost <= 0 AND list_has_any(role_hints, {list(rerank.FIRM_ROLES)}) AND NOT fits THEN -0.08::DOUBLE ELSE 0 END AS role_mismatch FROM boosted),
meant AS (SELECT *, CASE WHEN len(operations) > 0 AND list_has_any(targets, ['entrypoint', 'implementation', 'ui']) AND pr.name IN {_in(rerank.LOGIC_ROLES)} THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN list_contains(targets, 'config') AND pr.name IN {_in(rerank.CONFIG_LOGIC_ROLES)} THEN 0.12::DOUBLE ELSE 0 END
  + CASE WHEN list_contains(targets, 'deploy') AND wants_artifact AND pr.name = 'deployment_config' THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN list_contains(targets, 'doc') AND wants_artifact AND pr.name = 'doc' THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN list_contains(targets, 'test') AND wants_artifact AND pr.name = 'test' THEN 0.12::DOUBLE ELSE 0 END AS intent_boost,
  CASE WHEN len(operations) > 0 AND (len(targets) > 0 OR len(artifacts) > 0) AND NOT wants_artifact THEN CASE WHEN pr.name IN {_in(rerank.CONFIG_ARTIFACT_ROLES)} THEN -0.35::DOUBLE WHEN pr.name = 'generated_output' THEN -0.45 WHEN pr.name IN ('doc', 'test') THEN -0.20 ELSE 0 END ELSE 0 END AS intent_penalty FROM hints2),
demoted AS (SELECT *, least({_p('penalty')}, noise, intent_penalty) AS penalty,
  CASE WHEN file_hint OR role_hint_boost > 0 OR (pr.name = 'doc' AND list_contains(targets, 'doc') AND wants_artifact) OR (pr.name = 'test' AND list_contains(targets, 'test') AND wants_artifact)
    OR (pr.name IN ('config', 'runtime_config', 'config_example', 'deployment_config') AND list_has_any(targets, ['config', 'deploy']) AND wants_artifact) OR (pr.name = 'lockfile' AND (lockfile_asked OR (wants_artifact AND list_contains(artifacts, 'config_artifact'))))
    OR (pr.name = 'generated_output' AND wants_artifact AND list_contains(artifacts, 'generated_artifact')) OR (pr.name = 'config' AND source_boost > 0) THEN 0 ELSE coalesce({_map(rerank.ARTIFACT_PENALTIES)}[pr.name], 0) END AS demotion FROM meant),
seen AS (SELECT *, (token_coverage >= 0.2 AND ({_p('semantic')} >= 0.35 OR {_p('lexical')} >= 0.25)) OR {_p('path_symbol')} >= 1.0 OR token_coverage >= 0.5 AS strong, token_coverage > 0 OR {_p('semantic')} > 0 OR {_p('lexical')} > 0 OR {_p('path_symbol')} > 0 AS some_direct FROM demoted),
classed AS (SELECT *, CASE WHEN strong THEN 'original_direct' WHEN some_direct THEN 'weak_original_direct' ELSE 'weak_or_generic' END AS evidence_class,
  round({_p('semantic')} * 0.55 + {_p('lexical')} * 0.25 + least({_p('path_symbol')}, 5.0::DOUBLE) / 5 * 0.15 + token_coverage * 0.20 + source_boost + penalty, 9) AS combined FROM seen),
shares AS (SELECT *, CASE WHEN max(combined) OVER w <= 0 THEN 0 ELSE greatest(combined, 0::DOUBLE) / max(combined) OVER w END AS normalised FROM classed WINDOW w AS (PARTITION BY query_id)),
scored AS (SELECT *, round(normalised + CASE WHEN penalty < 0 THEN 0 WHEN strong THEN 0.2::DOUBLE WHEN some_direct THEN 0.05 ELSE 0 END - {_map(rerank.CHUNK_ROLES, 2)}[role] - demotion + CASE WHEN penalty = 0 AND contains(low, 'controller') THEN 0.15::DOUBLE ELSE 0 END + {_map(rerank.CHUNK_ROLES, 1)}[role]
  + CASE WHEN role = 'entrypoint' AND {_p('path_symbol')} >= 4 AND token_coverage >= 0.5 THEN 0.12::DOUBLE WHEN role IN ('service_impl', 'service') AND {_p('path_symbol')} >= 4 AND token_coverage >= 0.5 THEN 0.35 WHEN role = 'data_type' AND {_p('path_symbol')} >= 2 AND token_coverage >= 0.2 THEN 0.24 ELSE 0 END
  + identifier_boost + owner_boost + role_hint_boost + role_mismatch + CASE WHEN token_coverage >= 0.35 OR {_p('path_symbol')} >= 1.5 OR {_p('lexical')} >= 0.35 THEN intent_boost ELSE 0 END
  + CASE WHEN role = 'service_impl' AND {_p('path_symbol')} >= 1 AND token_coverage >= 0.25 THEN 0.18::DOUBLE ELSE 0 END, 9) AS pre_ceiling FROM shares),
roofed AS (SELECT *, coalesce(min(pre_ceiling) FILTER (strong AND role NOT IN ('handler', 'constant_or_config')) OVER w, min(pre_ceiling) FILTER (strong) OVER w) * (1 - 1e-6::DOUBLE) AS ceiling FROM scored WINDOW w AS (PARTITION BY query_id)),
clamps AS (SELECT *, evidence_class <> 'original_direct' AND coalesce(pre_ceiling > ceiling, false) AS clamped FROM roofed),
lowered AS (SELECT *, CASE WHEN clamped THEN ceiling ELSE pre_ceiling END AS below, nullif(unit, '') AS own_unit FROM clamps),
firsts AS (SELECT *, first_value(own_unit) OVER (PARTITION BY query_id ORDER BY below DESC, chunk_id DESC) AS first_unit, min(own_unit) OVER (PARTITION BY query_id) <> max(own_unit) OVER (PARTITION BY query_id) AS several FROM lowered),
final AS (SELECT *, round(below - CASE WHEN coalesce(several AND own_unit <> first_unit, false) THEN 0.05::DOUBLE ELSE 0 END, 9) AS rerank, CASE evidence_class WHEN 'original_direct' THEN 0 WHEN 'weak_original_direct' THEN 1 ELSE 4 END AS evidence_priority FROM firsts),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank, 3) DESC, evidence_priority, CASE WHEN clamped THEN 0 ELSE 1 END, CASE WHEN clamped THEN pre_ceiling ELSE 0 END DESC, {_map(rerank.CHUNK_ROLES, 0)}[role], rerank DESC, combined DESC, path, start_line, chunk_id)::INT AS position FROM final)
"""

ORDERED = """WITH c AS (SELECT query_id, chunk_id, max(score) AS score FROM ranked_chunks WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS turn FROM c),
s AS (SELECT chunk_id, min(file_path) AS path, min(start_line) AS start_line, max(end_line) AS end_line FROM code_signals WHERE deleted_at IS NULL AND chunk_id IS NOT NULL GROUP BY ALL),
ordered AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY turn)::INT AS place, chunk_id, path, start_line, end_line FROM w JOIN s USING (chunk_id))
"""

QUERIES = {f.__name__: f for f in (f12_path_roles, f14_intents, f14_document_intents, f15_identifiers, f11_noise, f6_rerank, f6_parts, f10_reranked_order, f26_rank_tiers, f30_split, f5_evidence, f32_summary, g1_pack_items, d1_ordered_chunks, a19_packs, i10_status, f19_context, f22_frontend_roles, f22_frontend_parts, e11_cohorts, e3_seeds, e10_test_targets, a6_test_paths)}

ORACLES = {
    "f12_path_roles": f"WITH {FILES} SELECT file_id, r.name AS role, r.priority AS priority FROM (SELECT file_id, {_sql_role()} AS r FROM files)",
    "f14_intents": f"WITH {QUERY_TEXTS}, {_sql_intents('q', 'query_id', TOKENS)} SELECT query_id, array_to_string(operations, ',') AS operations, array_to_string(targets, ',') AS targets, array_to_string(artifacts, ',') AS artifacts, wants_artifact, confidence FROM intents",
    "f14_document_intents": f"WITH d AS (SELECT doc_id, text AS query_text FROM documents), {_sql_intents('d', 'doc_id', '[]::VARCHAR[]')} SELECT doc_id, array_to_string(operations, ',') AS operations, array_to_string(targets, ',') AS targets, array_to_string(artifacts, ',') AS artifacts, wants_artifact, confidence FROM intents",
    "f15_identifiers": rf"""WITH f AS (SELECT file_id, concat_ws(' ', 'why does', list_last(string_split(path, '/')), 'fail in the service', regexp_extract(path, '([^/.]+)\.[^/]*$', 1)) AS query_text FROM source_files), {_sql_identifiers('f', 'file_id', TOKENS)}
SELECT file_id, array_to_string(identifiers, ',') AS identifiers, array_to_string(file_hints, ',') AS file_hints, array_to_string(list_transform(file_hints, lambda f: '.' || list_last(string_split(f, '.'))), ',') AS suffix_hints, array_to_string(role_hints, ',') AS role_hints, exact_identifier FROM hinted""",
    "f11_noise": f"WITH noisy AS (SELECT file_id, path, is_test, is_generated, lower(coalesce(path, '')) AS low, 'where is the upload handler' AS query_text, ['where', 'is', 'the', 'upload', 'handler'] AS query_tokens FROM source_files), {NOISE} SELECT file_id, file_role, noise, source_boost, lockfile_asked FROM judged",
    "f6_rerank": RERANKED + "SELECT query_id, chunk_id, round(combined, 6) AS combined, round(pre_ceiling, 6) AS pre_ceiling, round(rerank, 6) AS rerank, evidence_class, clamped FROM placed",
    "f6_parts": RERANKED + "SELECT query_id, chunk_id, pr.name AS path_role, role, file_role, round(token_coverage, 6) AS token_coverage, penalty, demotion, round(identifier_boost, 6) AS identifier_boost, owner_boost, role_hint_boost, role_mismatch, round(intent_boost, 6) AS intent_boost FROM placed",
    "f10_reranked_order": RERANKED + "SELECT query_id, chunk_id, position FROM placed",
    "f26_rank_tiers": RERANKED + "SELECT query_id, chunk_id, 3 AS tier FROM placed",
    "f30_split": RERANKED
    + r""", kinds2 AS (SELECT *, CASE WHEN regexp_matches(low, '(?:^|/)readme[^/]*\.md$') THEN 'readme' WHEN regexp_matches(low, '(?:^|/)risks[^/]*\.md$') THEN 'risks' WHEN regexp_matches(low, '(?:^|/)pom\.xml$') THEN 'pom' ELSE 'result' END AS kind FROM placed),
best AS (SELECT query_id, path, kind, min(position) AS position, arg_min(chunk_id, position) AS chunk_id FROM kinds2 GROUP BY ALL),
counted AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind <> 'result' ORDER BY position)::INT AS place FROM best)
SELECT query_id, chunk_id, path, kind, place FROM counted WHERE place <= CASE WHEN kind = 'result' THEN 12 ELSE 4 END""",
    "f5_evidence": RERANKED + "SELECT r.recorded, p.evidence_class, count(*) AS candidates, max(p.evidence_priority) AS priority FROM placed p JOIN (SELECT query_id, chunk_id, min(evidence_class) AS recorded FROM ranked_chunks GROUP BY ALL) r USING (query_id, chunk_id) GROUP BY ALL",
    "g1_pack_items": RERANKED
    + r""", best AS (SELECT query_id, path, min(position) AS position, arg_min(chunk_id, position) AS chunk_id FROM placed WHERE NOT regexp_matches(low, '(?:^|/)(?:readme|risks)[^/]*\.md$|(?:^|/)pom\.xml$') GROUP BY ALL),
counted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position)::INT AS place FROM best QUALIFY place <= 12),
sized AS (SELECT c.*, strlen(coalesce(k.content, ''))::BIGINT AS bytes FROM counted c JOIN chunks k USING (chunk_id)), summed AS (SELECT *, (sum(bytes) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM sized)
SELECT query_id, path, chunk_id, place, bytes, total FROM summed WHERE total <= 16384""",
    "d1_ordered_chunks": ORDERED + "SELECT * FROM ordered",
    "a19_packs": ORDERED
    + """, items AS (SELECT query_id, place, '{"place":' || place || ',"chunk_id":"' || chunk_id || '","path":"' || path || '"}' AS item FROM ordered),
summed AS (SELECT *, sum(strlen(item) + 1) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS total FROM items), packed AS (SELECT query_id, '[' || string_agg(item, ',' ORDER BY place) || ']' AS json, count(*)::INT AS items FROM summed WHERE total + 1 <= 2048 GROUP BY ALL)
SELECT *, strlen(json)::INT AS bytes FROM packed""",
    "i10_status": f"""WITH {LATEST}, c AS (SELECT repo_key, """ + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("added", "deleted", "changed", "touched", "unchanged")) + """ FROM diff GROUP BY ALL),
r AS (SELECT repo_key, max((started_at, run_id, status))[3] AS last_status, max(generation) FILTER (status = 'succeeded') AS generation FROM index_runs GROUP BY ALL) SELECT * FROM c FULL JOIN r USING (repo_key)""",
    "f19_context": RERANKED
    + """, m AS (SELECT p.query_id, p.chunk_id, p.role, s.kind FROM placed p JOIN code_signals s USING (chunk_id) WHERE s.deleted_at IS NULL AND s.kind IN ('method', 'field') AND ends_with(p.low, '.java') AND len(list_intersect(list_transform(p.query_tokens, lambda t: lower(t)), list_transform(coalesce(s.tokens, []), lambda t: lower(t)))) >= 2)
SELECT query_id, chunk_id, max(CASE WHEN kind = 'method' THEN 0.14::DOUBLE ELSE 0 END) AS method, max(CASE WHEN kind = 'field' THEN 0.12::DOUBLE ELSE 0 END) AS field, max(CASE WHEN role = 'executor' THEN 0.10::DOUBLE ELSE 0 END) AS executor FROM m GROUP BY ALL""",
    "f22_frontend_roles": r"WITH p AS (SELECT file_id, lower(path) AS low, CASE WHEN regexp_matches(lower(path), '(?:^|/)src/') THEN 'src/' || regexp_extract(lower(path), '(?:^|/)src/(.*)$', 1) ELSE lower(path) END AS src FROM source_files) SELECT file_id, CASE WHEN regexp_matches(low, '" + frontend.LOCKFILE + "') THEN 'lockfile' WHEN regexp_matches(low, '" + frontend.SCRATCH + "') THEN 'scratch_temp' WHEN NOT regexp_matches(low, '" + frontend.SOURCE + "') THEN 'other' " + " ".join(f"WHEN regexp_matches(src, '{pattern}') THEN '{name}'" for name, pattern in frontend.PLACES) + " ELSE 'other' END AS role FROM p",
    "e3_seeds": """WITH c AS (SELECT DISTINCT ON (query_id, chunk_id) query_id, chunk_id, coalesce(CASE WHEN NOT isnan(score_parts['path_symbol']) THEN score_parts['path_symbol'] END, 0) AS s, coalesce(CASE WHEN NOT isnan(score_parts['semantic']) THEN score_parts['semantic'] END, 0) AS p FROM ranked_chunks)
SELECT query_id, chunk_id, round(CASE WHEN s > 0 THEN least(s, 1.0::DOUBLE) ELSE least(p, 1.0::DOUBLE) * 0.65::DOUBLE END, 6) AS score, CASE WHEN s > 0 THEN 'signal' ELSE 'planner_signal' END AS source, CASE WHEN s > 0 THEN 1 ELSE 4 END AS priority FROM c WHERE s > 0 OR p > 0""",
}
