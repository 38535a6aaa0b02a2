"""Queries on lookups, the relation graph and refresh, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import distinct_lower, identifier_tokens
from brindle.operators import graph, lookup, refresh
from brindle.operators.chunking import first_per_group
from brindle.operators.intent import TARGETS, with_query_intent
from brindle.sources import trees
from brindle.sources.tables import table


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_signals")


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_relations")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files")


def a5_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language by suffix beside the recorded one."""
    mapped = trees.language_of(F.col("path"))
    return _files(spark, d).select("file_id", mapped.alias("by_suffix"), F.coalesce(F.lower("language") == mapped, F.lit(False)).alias("agrees"))


def a2_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Eligible files and skips by reason per repository."""
    texts = table(spark, d, "file_texts")
    content = F.coalesce("content", F.lit(""))
    reason = F.when(F.contains(F.substring(content, 1, 4096), F.lit("\x00")), "binary").when(F.octet_length(content) > 500_000, "too_large").when(F.instr("path", "..") > 0, "unsafe_path").otherwise("eligible")
    return _files(spark, d).join(texts, "file_id").select("repo_key", reason.alias("reason")).groupBy("repo_key", "reason").agg(F.count("*").alias("files"))


def d2_file_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each file in order of their lines."""
    chunks = lookup.live(_signals(spark, d)).filter(F.col("chunk_id").isNotNull()).groupBy("file_path", "chunk_id").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    from brindle.operators.ranking import ordered

    return ordered(chunks, "file_path", ["start_line", "end_line", "chunk_id"]).select("file_path", "chunk_id", "start_line", "end_line", "position")


def d3_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Files in the directory of each test."""
    files = _files(spark, d)
    return lookup.siblings(files, files.filter("is_test")).select("repo_key", "path", "sibling")


def d4_signal_at_line(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest signal over the first line of every other signal."""
    spans = lookup.live(_signals(spark, d)).select("file_path", "start_line", "end_line", "signal_id").distinct()
    points = spans.select("file_path", F.col("start_line").alias("line")).distinct()
    return lookup.spans_at(points, spans, "file_path")


def d5_named_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of live signals whose name a relation asks for."""
    names = lookup.live(_relations(spark, d)).select(F.col("target_name").alias("name")).dropna().distinct()
    return lookup.live(_signals(spark, d)).filter(F.col("chunk_id").isNotNull()).join(names, "name", "left_semi").select("name", "chunk_id").distinct()


def d7_id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with live signals, with deleted ones only, and with vectors."""
    signals = _signals(spark, d).filter(F.col("chunk_id").isNotNull())
    alive = signals.groupBy("chunk_id").agg(F.max(F.col("deleted_at").isNull()).alias("alive"))
    vectors = table(spark, d, "chunk_vectors").select("chunk_id").dropna().distinct().withColumn("vector", F.lit(True))
    return alive.join(vectors, "chunk_id", "full_outer").groupBy(F.coalesce("alive", F.lit(False)).alias("alive"), F.coalesce("vector", F.lit(False)).alias("vector")).agg(F.count("*").alias("chunks"))


def d9_language_counts(spark: SparkSession, d: str) -> DataFrame:
    return lookup.language_counts(_files(spark, d))


def d10_profile_files(spark: SparkSession, d: str) -> DataFrame:
    return lookup.profile_files(_files(spark, d), _signals(spark, d))


def d11_profile_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Commonest symbol names per project unit."""
    rows = lookup.live(_signals(spark, d)).filter(F.col("kind").isin("type", "method", "function", "endpoint"))
    return lookup.top_counts(rows.select("project_unit_key", "name"), "project_unit_key", "name", 48).select("project_unit_key", "name", "n", "position")


def d12_profile_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Commonest tokens of documents per source."""
    rows = table(spark, d, "documents").select(F.lower(F.trim("source")).alias("source"), F.explode(identifier_tokens(F.col("text"))).alias("token")).withColumn("token", F.lower("token"))
    return lookup.top_counts(rows, "source", "token", 64).select("source", "token", "n", "position")


def d13_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the index tables."""
    counts = [
        _files(spark, d).agg(F.count("*").alias("n")).withColumn("name", F.lit("files")),
        _signals(spark, d).agg(F.count_if(F.col("deleted_at").isNull()).alias("n")).withColumn("name", F.lit("live_signals")),
        _signals(spark, d).agg(F.count_if(F.col("deleted_at").isNotNull()).alias("n")).withColumn("name", F.lit("deleted_signals")),
        _relations(spark, d).agg(F.count_if(F.col("deleted_at").isNull()).alias("n")).withColumn("name", F.lit("live_relations")),
        table(spark, d, "chunk_vectors").agg(F.count_distinct("chunk_id").alias("n")).withColumn("name", F.lit("embedded_chunks")),
    ]
    total = counts[0]
    for one in counts[1:]:
        total = total.unionByName(one)
    return total


def d14_projection(spark: SparkSession, d: str) -> DataFrame:
    """Distinct neighbours in and out per live signal, and how many a view of 32 leaves out."""
    live = lookup.live(_relations(spark, d)).filter(F.col("resolution").isin(*graph.RESOLVED)).select("source_signal_id", "target_signal_id").dropna().distinct()
    out = live.groupBy(F.col("source_signal_id").alias("signal_id")).agg(F.count("*").alias("out_degree"))
    into = live.groupBy(F.col("target_signal_id").alias("signal_id")).agg(F.count("*").alias("in_degree"))
    ids = lookup.live(_signals(spark, d)).select("signal_id").distinct()
    joined = ids.join(out, "signal_id", "left").join(into, "signal_id", "left").na.fill(0, ["out_degree", "in_degree"])
    omitted = {f"{side}_omitted": F.greatest(F.col(f"{side}_degree") - 32, F.lit(0)) for side in ("out", "in")}
    return joined.filter((F.col("out_degree") > 0) | (F.col("in_degree") > 0)).withColumns(omitted)


def d14_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The first 32 neighbours each way of every live signal, by id."""
    live = lookup.live(_relations(spark, d)).filter(F.col("resolution").isin(*graph.RESOLVED)).select("source_signal_id", "target_signal_id").dropna().distinct()
    ids = lookup.live(_signals(spark, d)).select("signal_id").distinct()
    out = live.select(F.col("source_signal_id").alias("signal_id"), F.lit("out").alias("way"), F.col("target_signal_id").alias("neighbour"))
    into = live.select(F.col("target_signal_id").alias("signal_id"), F.lit("in").alias("way"), F.col("source_signal_id").alias("neighbour"))
    return first_per_group(out.unionByName(into).join(ids, "signal_id", "left_semi"), ["signal_id", "way"], ["neighbour"], 32).select("signal_id", "way", "neighbour", "position")


def d16_outgoing(spark: SparkSession, d: str) -> DataFrame:
    return lookup.edges(_relations(spark, d), _signals(spark, d), "source").select("signal_id", "relation_id", "weight", "position")


def d16_incoming(spark: SparkSession, d: str) -> DataFrame:
    return lookup.edges(_relations(spark, d), _signals(spark, d), "target").select("signal_id", "relation_id", "weight", "position")


def d18_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """Ten counts: chunks, signals and relations alive and deleted; symbols (signals with a
    name) and associations (relations of tests), and those whose chunk or target is gone."""
    signals, relations = _signals(spark, d), _relations(spark, d)
    alive = lookup.live(signals)
    chunks = signals.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max(F.col("deleted_at").isNull()).alias("alive"))
    lost = alive.filter(F.col("name").isNotNull()).join(chunks.filter("alive").select("chunk_id"), "chunk_id", "left_anti")
    tests = lookup.live(relations).filter(F.col("kind") == "tests")
    stray = tests.join(alive.select(F.col("signal_id").alias("target_signal_id")).distinct(), "target_signal_id", "left_anti")
    count = lambda df, name, where: df.agg(F.count_if(F.expr(where)).alias("n")).select(F.lit(name).alias("name"), "n")
    rows = [
        count(chunks, "active_chunks", "alive"), count(chunks, "deleted_chunks", "NOT alive"),
        count(signals, "active_signals", "deleted_at IS NULL"), count(signals, "deleted_signals", "deleted_at IS NOT NULL"),
        count(relations, "active_relations", "deleted_at IS NULL"), count(relations, "deleted_relations", "deleted_at IS NOT NULL"),
        count(alive, "active_symbols", "name IS NOT NULL"), count(lost, "orphan_symbols", "true"), count(tests, "active_associations", "true"), count(stray, "orphan_associations", "true"),
    ]
    return functools.reduce(DataFrame.unionByName, rows)


def d18_orphan_relations(spark: SparkSession, d: str) -> DataFrame:
    """Live relations without a live source chunk, per kind."""
    chunks = lookup.live(_signals(spark, d)).select(F.col("chunk_id").alias("source_chunk_id")).dropna().distinct()
    return lookup.live(_relations(spark, d)).join(chunks, "source_chunk_id", "left_anti").groupBy("kind").agg(F.count("*").alias("relations"))


def d19_purge(spark: SparkSession, d: str) -> DataFrame:
    return refresh.purgeable(_signals(spark, d))


def d19_purged(spark: SparkSession, d: str) -> DataFrame:
    """What a purge of the 1,000 oldest tombstones leaves, per kind."""
    left = refresh.purged(_signals(spark, d), "signal_id", batch=1000)
    return left.groupBy("kind").agg(F.count("*").alias("signals"), F.count_if(F.col("deleted_at").isNotNull()).alias("tombstones"))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Live signals of the candidates of each query, at their semantic score."""
    ranked = table(spark, d, "ranked_chunks").select("query_id", "chunk_id", F.element_at("score_parts", F.lit("semantic")).alias("score"))
    known = ranked.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    signals = lookup.live(_signals(spark, d)).select("chunk_id", "signal_id").dropna().distinct()
    return known.join(signals, "chunk_id").groupBy("query_id", "signal_id").agg(F.round(F.max("score"), 6).alias("score"))


def d15_graph_seeds(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d)


def e4_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Signals within four steps of the seeds of each query; over tests only where the query
    asks for them."""
    texts = table(spark, d, "ranked_chunks").select("query_id", "query_text").distinct().withColumn("query_tokens", distinct_lower(identifier_tokens(F.col("query_text"))))
    asks = with_query_intent(texts).select("query_id", F.array_contains("targets", "test").alias("follow_tests"))
    return graph.expand(_seeds(spark, d).join(asks, "query_id"), graph.steps(_relations(spark, d)))


def e5_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d).select("relation_id", F.round(graph.effective_confidence(), 6).alias("confidence")).groupBy("relation_id").agg(F.max("confidence").alias("confidence"))


def e6_named_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Signals reached by the bare name of unresolved targets, one step."""
    loose = lookup.live(_relations(spark, d)).filter(~F.col("resolution").isin(*graph.RESOLVED, "external")).select("source_signal_id", F.col("target_name").alias("name")).dropna().distinct()
    signals = lookup.live(_signals(spark, d)).select("name", "signal_id").dropna().distinct()
    return loose.join(signals, "name").filter(F.col("source_signal_id") != F.col("signal_id")).select("source_signal_id", "signal_id").distinct()


def e8_resolution(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_targets(_relations(spark, d), _signals(spark, d))


def e9_test_subjects(spark: SparkSession, d: str) -> DataFrame:
    return graph.test_subjects(_files(spark, d))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return refresh.snapshot_diff(refresh.latest_snapshot(table(spark, d, "source_observations")), _files(spark, d))


def i3_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """The last observation of every file (the older side) against the current snapshot."""
    return _diff(spark, d)


def i4_dependents(spark: SparkSession, d: str) -> DataFrame:
    return refresh.dependents(_diff(spark, d), _relations(spark, d), _signals(spark, d))


def i5_retries(spark: SparkSession, d: str) -> DataFrame:
    """The 100 skips to try again first."""
    return refresh.retry_order(table(spark, d, "scan_skips"), 100).select("repo_key", "path", "reason")


def i6_health(spark: SparkSession, d: str) -> DataFrame:
    """Health of every repository from its runs and differences."""
    runs = table(spark, d, "index_runs").groupBy("repo_key").agg(
        F.count_if(F.col("status") == "succeeded").alias("good"),
        F.max(F.struct("started_at", "run_id", "status"))["status"].alias("last"),
        F.count_if(F.col("finished_at").isNull()).alias("open"),
        F.max(F.when(F.col("status") == "succeeded", F.col("generation"))).alias("built"),
    )
    seen = table(spark, d, "source_observations").groupBy("repo_key").agg(F.max("observation_generation").alias("seen"))
    moved = _diff(spark, d).groupBy("repo_key").agg(F.count_if(F.col("state").isin("added", "deleted", "changed")).alias("moved"))
    row = runs.join(moved, "repo_key", "left").join(seen, "repo_key", "left").select(
        "repo_key",
        (F.col("good") > 0).alias("available"),
        # An index of a generation that was never observed belongs to another history.
        F.coalesce(F.col("built") <= F.col("seen"), F.lit(True)).alias("compatible"),
        (F.col("last") == "aborted").alias("corrupt"),
        (F.col("open") == 0).alias("writer_idle"),
        (F.coalesce("moved", F.lit(0)) > 0).alias("stale"),
        (F.col("last") == "failed").alias("degraded"),
        (F.col("last") == "succeeded").alias("verified"),
    )
    return refresh.health(row).select("repo_key", "health")


def i7_vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per config after each chunk's newest has taken the place of its others and
    those of deleted chunks are taken out."""
    vectors = table(spark, d, "chunk_vectors").select("chunk_id", "config_hash", "vec_id")
    newest = vectors.dropna().groupBy("chunk_id", "config_hash").agg(F.max("vec_id").alias("vec_id"))
    dead = _signals(spark, d).groupBy("chunk_id").agg(F.min(F.col("deleted_at").isNotNull()).alias("dead")).filter("dead").select("chunk_id")
    return refresh.upserted(vectors, newest, dead, ["chunk_id", "config_hash"], "chunk_id").groupBy("config_hash").agg(F.count("*").alias("vectors"), F.sum("vec_id").alias("ids"))


# --- SQL ---------------------------------------------------------------------------
LIVE = "live AS (SELECT * FROM code_signals WHERE deleted_at IS NULL), rel AS (SELECT * FROM code_relations WHERE deleted_at IS NULL)"
CONF = "CASE WHEN resolution IN ('resolved_exact', 'resolved_unique') THEN least(coalesce(producer_confidence, confidence), coalesce(resolution_confidence, 1.0)) ELSE coalesce(producer_confidence, confidence) END"
WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in graph.KIND_WEIGHTS.items()) + " END"
SEEDS = """sem AS (SELECT query_id, chunk_id, score_parts['semantic'] AS score FROM ranked_chunks),
seeds AS (SELECT query_id, signal_id, round(max(s.score), 6) AS score FROM sem s JOIN live USING (chunk_id) WHERE s.score IS NOT NULL AND NOT isnan(s.score) GROUP BY ALL)"""
STEPS = f"""usable AS (SELECT source_signal_id AS s, target_signal_id AS t, kind, {CONF} AS c, round(({CONF}) * ({WEIGHT}) * 0.8::DOUBLE, 9) AS factor FROM rel WHERE resolution IN ('resolved_exact', 'resolved_unique')),
walk AS (SELECT s AS f, t, kind, factor FROM usable WHERE c >= 0.5 AND factor IS NOT NULL UNION ALL SELECT t, s, kind, factor FROM usable WHERE c >= 0.5 AND factor IS NOT NULL AND kind NOT IN ('calls', 'imports', 'routes_to', 'uses_type')),
steps AS (SELECT f, t, kind = 'tests' AS over_tests, max(factor) AS factor FROM walk WHERE f IS NOT NULL AND t IS NOT NULL AND f <> t GROUP BY ALL),
asks AS (SELECT query_id, bool_or(list_has_any(regexp_extract_all(lower(query_text), '[a-z0-9_]+'), """ + str([w for w in TARGETS["test"].split() if w.isascii()]) + """) OR contains(query_text, '测试')) AS follow_tests FROM ranked_chunks GROUP BY query_id)"""
LATEST = """latest AS (SELECT repo_key, path, max((observation_generation, received_at, lower(sha256), mtime_ns)) AS n FROM source_observations GROUP BY ALL),
diff AS (SELECT coalesce(a.repo_key, b.repo_key) AS repo_key, coalesce(a.path, b.path) AS path,
  CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.n[3] IS DISTINCT FROM lower(b.sha256) THEN 'changed' WHEN a.n[4] IS DISTINCT FROM b.mtime_ns THEN 'touched' ELSE 'unchanged' END AS state
  FROM latest a FULL JOIN source_files b ON a.repo_key = b.repo_key AND a.path = b.path)"""
BARE = r"regexp_replace(regexp_replace(regexp_extract(path, '([^/]+)\.[^./]+$', 1), '^(test_|Test)', ''), '(_test|Test|Tests|IT|\.test|\.spec)$', '')"


def sql_edges(side: str) -> str:
    return f"""WITH {LIVE}, w AS (SELECT DISTINCT {side}_signal_id AS signal_id, relation_id, kind, round(({CONF}) * coalesce({WEIGHT}, 0), 6) AS weight FROM rel WHERE resolution IN ('resolved_exact', 'resolved_unique'))
SELECT signal_id, relation_id, weight, row_number() OVER (PARTITION BY signal_id ORDER BY weight DESC, kind, relation_id)::INT AS position FROM w WHERE signal_id IN (SELECT signal_id FROM live) QUALIFY position <= 65"""


QUERIES = {
    f.__name__: f
    for f in (
        a5_languages, a2_inventory, d2_file_chunks, d3_siblings, d4_signal_at_line, d5_named_chunks, d7_id_sets, d9_language_counts, d10_profile_files, d11_profile_symbols, d12_profile_tokens, d13_stats,
        d14_projection, d14_neighbours, d15_graph_seeds, d16_outgoing, d16_incoming, d18_maintenance, d18_orphan_relations, d19_purge, d19_purged, e4_expansion, e5_confidence, e6_named_neighbours, e8_resolution, e9_test_subjects, i3_snapshot_diff, i4_dependents,
        i5_retries, i6_health, i7_vector_upsert,
    )
}

from brindle.plans.text_queries import sql_tokens  # noqa: E402

ORACLES = {
    "a5_languages": r"WITH m AS (SELECT file_id, lower(language) AS l, CASE lower(regexp_extract(path, '\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in trees.LANGUAGES.items()) + " END AS by_suffix FROM source_files) SELECT file_id, by_suffix, coalesce(l = by_suffix, false) AS agrees FROM m",
    "a2_inventory": "SELECT repo_key, CASE WHEN contains(coalesce(content, '')[1:4096], chr(0)) THEN 'binary' WHEN strlen(coalesce(content, '')) > 500000 THEN 'too_large' WHEN contains(path, '..') THEN 'unsafe_path' ELSE 'eligible' END AS reason, count(*) AS files FROM source_files JOIN file_texts USING (file_id) GROUP BY ALL",
    "d2_file_chunks": f"WITH {LIVE}, c AS (SELECT file_path, chunk_id, min(start_line) AS start_line, max(end_line) AS end_line FROM live WHERE chunk_id IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line, end_line, chunk_id)::INT AS position FROM c",
    "d3_siblings": "WITH f AS (SELECT repo_key, path, is_test, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder FROM source_files) SELECT a.repo_key, a.path, b.path AS sibling FROM f a JOIN f b ON a.repo_key = b.repo_key AND a.folder = b.folder AND a.path <> b.path WHERE a.is_test",
    "d4_signal_at_line": f"WITH {LIVE}, s AS (SELECT DISTINCT file_path, start_line, end_line, signal_id FROM live), p AS (SELECT DISTINCT file_path, start_line AS line FROM s) SELECT p.file_path, p.line, min((-s.start_line, s.end_line, s.signal_id))[3] AS signal_id FROM p JOIN s ON s.file_path = p.file_path AND p.line BETWEEN s.start_line AND s.end_line GROUP BY ALL",
    "d5_named_chunks": f"WITH {LIVE} SELECT DISTINCT name, chunk_id FROM live WHERE chunk_id IS NOT NULL AND name IN (SELECT target_name FROM rel)",
    "d7_id_sets": "WITH a AS (SELECT chunk_id, bool_or(deleted_at IS NULL) AS alive FROM code_signals WHERE chunk_id IS NOT NULL GROUP BY ALL), v AS (SELECT DISTINCT chunk_id, true AS vector FROM chunk_vectors WHERE chunk_id IS NOT NULL) SELECT coalesce(alive, false) AS alive, coalesce(vector, false) AS vector, count(*) AS chunks FROM a FULL JOIN v USING (chunk_id) GROUP BY ALL",
    "d9_language_counts": "WITH c AS (SELECT lower(language) AS language, count(*) AS files FROM source_files GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY CASE WHEN language IN ('java', 'python', 'typescript', 'javascript', 'go') THEN 0 ELSE 1 END, files DESC, language NULLS FIRST)::INT AS position FROM c",
    "d10_profile_files": f"WITH {LIVE}, s AS (SELECT file_path AS path, count(DISTINCT name) AS symbols FROM live GROUP BY ALL) SELECT repo_key, path, coalesce(symbols, 0) AS symbols, row_number() OVER (PARTITION BY repo_key ORDER BY coalesce(is_generated, false), coalesce(is_test, false), coalesce(symbols, 0) DESC, length(path), path)::INT AS position FROM source_files LEFT JOIN s USING (path) QUALIFY position <= 16",
    "d11_profile_symbols": f"WITH {LIVE}, c AS (SELECT project_unit_key, name, count(*) AS n FROM live WHERE kind IN ('type', 'method', 'function', 'endpoint') GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY project_unit_key ORDER BY n DESC, name)::INT AS position FROM c QUALIFY position <= 48",
    "d12_profile_tokens": f"WITH t AS (SELECT lower(trim(source)) AS source, lower(unnest({sql_tokens('text')})) AS token FROM documents), c AS (SELECT source, token, count(*) AS n FROM t GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token)::INT AS position FROM c QUALIFY position <= 64",
    "d13_stats": "SELECT count(*) AS n, 'files' AS name FROM source_files UNION ALL SELECT count(*) FILTER (deleted_at IS NULL), 'live_signals' FROM code_signals UNION ALL SELECT count(*) FILTER (deleted_at IS NOT NULL), 'deleted_signals' FROM code_signals UNION ALL SELECT count(*) FILTER (deleted_at IS NULL), 'live_relations' FROM code_relations UNION ALL SELECT count(DISTINCT chunk_id), 'embedded_chunks' FROM chunk_vectors",
    "d14_projection": f"WITH {LIVE}, e AS (SELECT DISTINCT source_signal_id AS s, target_signal_id AS t FROM rel WHERE resolution IN ('resolved_exact', 'resolved_unique') AND source_signal_id IS NOT NULL AND target_signal_id IS NOT NULL), o AS (SELECT s AS signal_id, count(*) AS out_degree FROM e GROUP BY ALL), i AS (SELECT t AS signal_id, count(*) AS in_degree FROM e GROUP BY ALL) SELECT signal_id, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, greatest(coalesce(out_degree, 0) - 32, 0) AS out_omitted, greatest(coalesce(in_degree, 0) - 32, 0) AS in_omitted FROM (SELECT DISTINCT signal_id FROM live) LEFT JOIN o USING (signal_id) LEFT JOIN i USING (signal_id) WHERE coalesce(out_degree, 0) + coalesce(in_degree, 0) > 0",
    "d14_neighbours": f"WITH {LIVE}, e AS (SELECT DISTINCT source_signal_id AS s, target_signal_id AS t FROM rel WHERE resolution IN ('resolved_exact', 'resolved_unique') AND source_signal_id IS NOT NULL AND target_signal_id IS NOT NULL), n AS (SELECT s AS signal_id, 'out' AS way, t AS neighbour FROM e UNION ALL SELECT t, 'in', s FROM e) SELECT signal_id, way, neighbour, row_number() OVER (PARTITION BY signal_id, way ORDER BY neighbour)::INT AS position FROM n WHERE signal_id IN (SELECT signal_id FROM live) QUALIFY position <= 32",
    "d15_graph_seeds": f"WITH {LIVE}, {SEEDS} SELECT * FROM seeds",
    "d16_outgoing": sql_edges("source"),
    "d16_incoming": sql_edges("target"),
    "d18_maintenance": f"""WITH {LIVE}, c AS (SELECT chunk_id, bool_or(deleted_at IS NULL) AS alive FROM code_signals WHERE chunk_id IS NOT NULL GROUP BY ALL)
SELECT 'active_chunks' AS name, count(*) FILTER (alive) AS n FROM c UNION ALL SELECT 'deleted_chunks', count(*) FILTER (NOT alive) FROM c
UNION ALL SELECT 'active_signals', count(*) FROM live UNION ALL SELECT 'deleted_signals', count(*) FROM code_signals WHERE deleted_at IS NOT NULL
UNION ALL SELECT 'active_relations', count(*) FROM rel UNION ALL SELECT 'deleted_relations', count(*) FROM code_relations WHERE deleted_at IS NOT NULL
UNION ALL SELECT 'active_symbols', count(*) FROM live WHERE name IS NOT NULL UNION ALL SELECT 'orphan_symbols', count(*) FROM live WHERE name IS NOT NULL AND (chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM c WHERE alive))
UNION ALL SELECT 'active_associations', count(*) FROM rel WHERE kind = 'tests' UNION ALL SELECT 'orphan_associations', count(*) FROM rel WHERE kind = 'tests' AND (target_signal_id IS NULL OR target_signal_id NOT IN (SELECT signal_id FROM live WHERE signal_id IS NOT NULL))""",
    "d19_purged": "WITH due AS (SELECT count(*) FILTER (deleted_at IS NOT NULL) AS t, count(*) AS n FROM code_signals), old AS (SELECT DISTINCT signal_id, deleted_at FROM code_signals, due WHERE deleted_at IS NOT NULL AND (t > n * 0.05 OR t > 5000) ORDER BY deleted_at, signal_id LIMIT 1000) SELECT kind, count(*) AS signals, count(*) FILTER (deleted_at IS NOT NULL) AS tombstones FROM code_signals s WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.signal_id = s.signal_id AND old.deleted_at = s.deleted_at) GROUP BY ALL",
    "d18_orphan_relations": f"WITH {LIVE} SELECT kind, count(*) AS relations FROM rel WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.chunk_id = rel.source_chunk_id) GROUP BY ALL",
    "d19_purge": "SELECT count(*) AS total, count(*) FILTER (deleted_at IS NOT NULL) AS tombstones, tombstones > total * 0.05 OR tombstones > 5000 AS purge FROM code_signals",
    "e4_expansion": f"""WITH {LIVE}, {SEEDS}, {STEPS},
""" + ",\n".join(f"h{n} AS (SELECT query_id, t AS signal_id, max(round(score * factor, 9)) AS score FROM {'seeds' if n == 1 else f'h{n - 1}'} JOIN steps ON signal_id = f JOIN asks USING (query_id) WHERE follow_tests OR NOT over_tests GROUP BY ALL)" for n in range(1, 5)) + """,
every AS (SELECT query_id, signal_id, score, 0 AS hops FROM seeds""" + "".join(f" UNION ALL SELECT query_id, signal_id, score, {n} FROM h{n}" for n in range(1, 5)) + """)
SELECT query_id, signal_id, max((score, -hops))[1] AS score, (-max((score, -hops))[2])::INT AS hops FROM every GROUP BY ALL""",
    "e5_confidence": f"SELECT relation_id, max(round({CONF}, 6)) AS confidence FROM code_relations GROUP BY relation_id",
    "e6_named_neighbours": f"WITH {LIVE} SELECT DISTINCT r.source_signal_id, s.signal_id FROM rel r JOIN live s ON s.name = r.target_name WHERE r.resolution NOT IN ('resolved_exact', 'resolved_unique', 'external') AND r.source_signal_id <> s.signal_id",
    "e8_resolution": f"""WITH {LIVE}, a AS (SELECT DISTINCT relation_id, target_kind, target_qualified_name, target_signature, target_arity, coalesce(target_signature, '') <> '' AS exact FROM rel WHERE coalesce(target_qualified_name, '') <> ''),
f AS (SELECT a.relation_id, count(DISTINCT s.signal_id) AS matches, min(s.signal_id) AS one, bool_or(exact) AS exact FROM a LEFT JOIN live s ON s.qualified_name = a.target_qualified_name
  AND (coalesce(a.target_kind, '') = '' OR a.target_kind = s.kind) AND (NOT exact OR a.target_signature = s.signature) AND (exact OR a.target_arity IS NULL OR a.target_arity = s.arity) GROUP BY ALL)
SELECT relation_id, matches, CASE WHEN matches = 1 THEN one END AS target_id, CASE WHEN matches = 0 THEN 'unresolved' WHEN matches > 1 THEN 'ambiguous' WHEN exact THEN 'resolved_exact' ELSE 'resolved_unique' END AS state,
  CASE WHEN matches = 1 THEN CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END END AS confidence FROM f""",
    "e9_test_subjects": rf"""WITH f AS (SELECT repo_key, path, coalesce(is_test, false) AS test, coalesce(is_generated, false) AS gen, regexp_extract(path, '([^/]+)\.[^./]+$', 1) AS name, {BARE} AS bare, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS suffix FROM source_files)
SELECT t.repo_key, t.path AS test_path, s.path, row_number() OVER (PARTITION BY t.repo_key, t.path ORDER BY s.path)::INT AS position FROM f t JOIN f s ON t.repo_key = s.repo_key AND t.bare = s.name AND t.suffix = s.suffix WHERE t.test AND NOT s.test AND NOT s.gen QUALIFY position <= 8""",
    "i3_snapshot_diff": f"WITH {LATEST} SELECT repo_key, path, state FROM diff",
    "i4_dependents": f"WITH {LIVE}, {LATEST}, ids AS (SELECT DISTINCT signal_id FROM code_signals WHERE file_path IN (SELECT path FROM diff WHERE state IN ('added', 'changed', 'deleted'))), r AS (SELECT DISTINCT source_file_path AS source_path, target_signal_id, relation_id FROM rel) SELECT source_path, count(*) AS reasons FROM r WHERE target_signal_id IN (SELECT signal_id FROM ids) GROUP BY ALL",
    "i5_retries": "SELECT repo_key, path, reason FROM scan_skips WHERE retryable ORDER BY coalesce(last_retry_generation, -1), first_observation_generation NULLS FIRST, repo_key NULLS FIRST, path NULLS FIRST LIMIT 100",
    "i6_health": f"""WITH {LATEST}, runs AS (SELECT repo_key, count(*) FILTER (status = 'succeeded') AS good, max((started_at, run_id, status))[3] AS last, count(*) FILTER (finished_at IS NULL) AS open, max(generation) FILTER (status = 'succeeded') AS built FROM index_runs GROUP BY ALL),
seen AS (SELECT repo_key, max(observation_generation) AS seen FROM source_observations GROUP BY ALL),
moved AS (SELECT repo_key, count(*) FILTER (state IN ('added', 'deleted', 'changed')) AS moved FROM diff GROUP BY ALL)
SELECT repo_key, CASE WHEN good = 0 THEN 'missing' WHEN NOT coalesce(built <= seen, true) THEN 'incompatible' WHEN last = 'aborted' AND open = 0 THEN 'corrupt' WHEN coalesce(moved, 0) > 0 THEN 'stale' WHEN last = 'failed' THEN 'degraded' WHEN last = 'succeeded' THEN 'healthy_verified' ELSE 'healthy_metadata' END AS health FROM runs LEFT JOIN moved USING (repo_key) LEFT JOIN seen USING (repo_key)""",
    "i7_vector_upsert": "WITH dead AS (SELECT chunk_id FROM code_signals WHERE chunk_id IS NOT NULL GROUP BY ALL HAVING bool_and(deleted_at IS NOT NULL)), v AS (SELECT chunk_id, config_hash, max(vec_id) AS vec_id FROM chunk_vectors WHERE chunk_id IS NOT NULL AND config_hash IS NOT NULL AND vec_id IS NOT NULL GROUP BY ALL UNION ALL SELECT chunk_id, config_hash, vec_id FROM chunk_vectors WHERE chunk_id IS NULL OR config_hash IS NULL) SELECT config_hash, count(*) AS vectors, sum(vec_id)::BIGINT AS ids FROM v WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM dead) GROUP BY ALL",
}
