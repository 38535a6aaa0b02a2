"""The typed relation graph: confidence, resolution and best-first expansion."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.operators.ranking import part
from brindle.session import cut_lineage

# Weights of the relation kinds that are followed, the loss per step,
# the least confidence, and the most steps.
KIND_WEIGHTS = {"calls": 1.0, "implements": 0.95, "implements_method": 0.95, "uses_type": 0.75, "imports": 0.85, "routes_to": 1.0, "mapped_by": 0.95, "tests": 0.8}
#: Kinds that are followed from source to target only.
FORWARD_ONLY = ("calls", "imports", "routes_to", "uses_type")
DECAY, LEAST_CONFIDENCE, MOST_HOPS = 0.8, 0.5, 4
RESOLVED = ("resolved_exact", "resolved_unique")


def kind_weight() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*KIND_WEIGHTS.items())]), F.col("kind"))


def effective_confidence() -> Column:
    """A resolved edge is as sure as the less sure of who made and who resolved it."""
    producer = F.coalesce("producer_confidence", "confidence")
    return F.when(F.col("resolution").isin(*RESOLVED), F.least(producer, F.coalesce("resolution_confidence", F.lit(1.0)))).otherwise(producer)


def steps(relations: DataFrame) -> DataFrame:
    """Edges that may be walked: ``from_id, to_id, kind, factor``, the best per pair and kind."""
    confidence = effective_confidence()
    usable = relations.filter(F.col("deleted_at").isNull() & F.col("resolution").isin(*RESOLVED)).withColumn("factor", F.round(confidence * kind_weight() * DECAY, 9)).filter((confidence >= LEAST_CONFIDENCE) & F.col("factor").isNotNull())
    forward = usable.select(F.col("source_signal_id").alias("from_id"), F.col("target_signal_id").alias("to_id"), "kind", "factor")
    backward = usable.filter(~F.col("kind").isin(*FORWARD_ONLY)).select(F.col("target_signal_id").alias("from_id"), F.col("source_signal_id").alias("to_id"), "kind", "factor")
    both = forward.unionByName(backward).filter(F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("from_id") != F.col("to_id")))
    return both.groupBy("from_id", "to_id", "kind").agg(F.max("factor").alias("factor"))


def expand(seeds: DataFrame, walkable: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """Signals reached from the seeds of each query with their best score, fewest steps
    first among equals: ``query_id, signal_id, score, hops``. ``seeds`` has ``query_id,
    signal_id, score`` and may have ``follow_tests``; seeds keep their own score. A step
    multiplies by the edge's factor. Edges of the kind ``tests`` are walked only for queries
    that ask for tests.

    Every level is one join on the signal id with the best score per query and signal kept.
    Only what beats the score a signal already has goes on: a factor is at most one, so
    nothing that starts from a lower score could. Edges and levels are written once each
    (building the result runs all levels but the last).
    """
    walkable = cut_lineage(walkable)
    key = ["query_id", "signal_id"]
    asks = seeds if "follow_tests" in seeds.columns else seeds.withColumn("follow_tests", F.lit(False))
    best = cut_lineage(asks.groupBy(*key).agg(F.max("score").alias("score"), F.max("follow_tests").alias("follow_tests")).withColumns({"hops": F.lit(0), "moved": F.lit(True)}))
    for hop in range(1, hops + 1):
        reached = (
            best.filter("moved")
            .join(walkable, (F.col("signal_id") == F.col("from_id")) & (F.col("follow_tests") | (F.col("kind") != "tests")))
            .select("query_id", F.col("to_id").alias("signal_id"), F.round(F.col("score") * F.col("factor"), 9).alias("now"), F.col("follow_tests").alias("asks_tests"))
            .groupBy(*key)
            .agg(F.max("now").alias("now"), F.max("asks_tests").alias("asks_tests"))
        )
        moved = F.col("now").isNotNull() & (F.col("score").isNull() | (F.col("now") > F.col("score")))
        best = best.drop("moved").join(reached, key, "full_outer").select(
            *key, F.greatest("score", "now").alias("score"), F.when(moved, F.lit(hop)).otherwise(F.col("hops")).alias("hops"), moved.alias("moved"), F.coalesce("follow_tests", "asks_tests").alias("follow_tests")
        )
        if hop < hops:
            best = cut_lineage(best)
    return best.select(*key, "score", "hops")


def resolve_targets(relations: DataFrame, signals: DataFrame) -> DataFrame:
    """Targets of live relations looked up by kind, qualified name, and signature or arity
    where given: ``relation_id, matches, target_id, state, confidence``. No match is
    ``unresolved``, one is ``resolved_exact`` if the signature was asked for and else
    ``resolved_unique``, several are ``ambiguous``."""
    asked = relations.filter(F.col("deleted_at").isNull() & (F.coalesce("target_qualified_name", F.lit("")) != "")).select("relation_id", "target_kind", "target_qualified_name", "target_signature", "target_arity").distinct()
    known = signals.filter(F.col("deleted_at").isNull()).select("signal_id", "kind", "qualified_name", "signature", "arity").distinct()
    exact = F.coalesce("target_signature", F.lit("")) != ""
    fits = (
        (F.col("target_qualified_name") == F.col("qualified_name"))
        & ((F.coalesce("target_kind", F.lit("")) == "") | (F.col("target_kind") == F.col("kind")))
        & (~exact | (F.col("target_signature") == F.col("signature")))
        & (exact | F.col("target_arity").isNull() | (F.col("target_arity") == F.col("arity")))
    )
    found = asked.join(known, fits, "left").groupBy("relation_id").agg(F.count_distinct("signal_id").alias("matches"), F.min("signal_id").alias("one"), F.max(exact).alias("exact"))
    state = F.when(F.col("matches") == 0, "unresolved").when(F.col("matches") > 1, "ambiguous").when(F.col("exact"), "resolved_exact").otherwise("resolved_unique")
    confidence = F.when(F.col("matches") == 1, F.when(F.col("exact"), 1.0).otherwise(0.9))
    return found.select("relation_id", "matches", F.when(F.col("matches") == 1, F.col("one")).alias("target_id"), state.alias("state"), confidence.alias("confidence"))


def test_subjects(files: DataFrame) -> DataFrame:
    """Tests and the production files their names stand for, unique within a repository:
    ``repo_key, test_path, path``. At most 8 per test."""
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    bare = F.regexp_replace(F.regexp_replace(name, "^(test_|Test)", ""), r"(_test|Test|Tests|IT|\.test|\.spec)$", "")
    is_test = F.coalesce("is_test", F.lit(False))
    generated = F.coalesce("is_generated", F.lit(False))
    tests = files.filter(is_test).select("repo_key", F.col("path").alias("test_path"), bare.alias("stem"), suffix.alias("suffix"))
    subjects = files.filter(~is_test & ~generated).select("repo_key", "path", name.alias("stem"), suffix.alias("suffix"))
    found = tests.join(subjects, ["repo_key", "stem", "suffix"])
    order = Window.partitionBy("repo_key", "test_path").orderBy("path")
    counted = found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= 8)
    return counted.select("repo_key", "test_path", "path", "position")


def relation_seeds(rows: DataFrame) -> DataFrame:
    """The score a candidate seeds the graph with, and where it comes from: ``query_id,
    chunk_id, score, source, priority``, of ``score_parts``. A relation comes before a signal,
    that before literal text, an anchor, and the signal of a planner, which counts .65;
    scores lie between 0 and 1. What has none of them seeds nothing."""
    held = lambda *keys: F.greatest(F.lit(0.0), *[part(k) for k in keys])
    sources = [("relation", held("relation"), 1.0), ("signal", held("signal"), 1.0), ("direct", held("direct_text"), 1.0), ("anchor", held("anchored_relation", "same_file_anchor", "directory_anchor"), 1.0), ("planner_signal", held("planner_signal"), 0.65)]
    chain = None
    for priority, (name, score, share) in enumerate(sources):
        made = F.struct((F.least(score, F.lit(1.0)) * share).alias("score"), F.lit(name).alias("source"), F.lit(priority).alias("priority"))
        chain = F.when(score > 0, made) if chain is None else chain.when(score > 0, made)
    return rows.select("query_id", "chunk_id", chain.alias("seed")).filter(F.col("seed").isNotNull()).select("query_id", "chunk_id", "seed.*")
