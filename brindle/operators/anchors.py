"""Expansion around anchors, roles of chunks, routes, bonuses, probes and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions.text import distinct_lower, identifier_tokens
from brindle.operators.lookup import directory

SAME_FILE, SAME_DIRECTORY = 0.80, 0.55
MOST_PROBES = 30


def literal_probes(query: Column) -> Column:
    """Literal texts to look for: the whole query, its parts, fragments of names and paths,
    and tokens of three letters or with ideographs; of more than 30 the longest."""
    trimmed = F.trim(query)
    fragments = F.regexp_extract_all(trimmed, F.lit(r"[A-Za-z0-9_./:@-]{3,}"), 0)
    tokens = F.filter(identifier_tokens(trimmed), lambda t: (F.length(t) >= 3) | t.rlike("[\\u3400-\\u9fff]"))
    every = F.array_distinct(F.filter(F.concat(F.array(trimmed), F.split(trimmed, r"\s+"), fragments, tokens), lambda p: p != ""))
    ordered = F.transform(F.array_sort(F.transform(every, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda s: s["p"])
    return F.when(F.size(every) > MOST_PROBES, F.slice(ordered, 1, MOST_PROBES)).otherwise(every)


def file_neighbours(anchors: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """Other chunks of the files of each query's anchors at a share of the anchor's score:
    ``query_id, chunk_id, score``. ``anchors`` has ``query_id, chunk_id, path, score``."""
    near = anchors.select("query_id", "path", F.col("score").alias("anchor")).join(chunks.select("path", "chunk_id"), "path")
    fresh = near.join(anchors.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return _best(fresh, SAME_FILE, most)


def directory_neighbours(anchors: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """Code beside each query's configuration and document anchors."""
    loose = anchors.filter(F.col("path").rlike(r"\.(md|ya?ml|json|xml|properties)$")).select("query_id", directory(F.col("path")).alias("folder"), F.col("score").alias("anchor"))
    code = chunks.filter(~F.col("path").rlike(r"\.(md|ya?ml|json|xml|properties)$")).select(directory(F.col("path")).alias("folder"), "chunk_id")
    fresh = loose.join(code, "folder").join(anchors.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return _best(fresh, SAME_DIRECTORY, most)


def _best(near: DataFrame, share: float, most: int) -> DataFrame:
    scored = near.groupBy("query_id", "chunk_id").agg(F.round(F.max("anchor") * share, 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most).drop("position")


def chunk_role(kinds: Column, path: Column) -> Column:
    """The role of a chunk by the kinds of its signals and its path, the first that fits."""
    return (
        F.when(F.array_contains(kinds, "endpoint") | F.array_contains(kinds, "route"), "entrypoint")
        .when(path.rlike(r"(Impl|Service)\.java$"), "service_impl")
        .when(path.rlike(r"(Executor|Worker|Handler|Job)\.[a-z]+$"), "executor")
        .when(F.array_contains(kinds, "mybatis_statement"), "data_access")
        .when(F.array_contains(kinds, "type") & ~F.array_contains(kinds, "method") & ~F.array_contains(kinds, "function"), "data_type")
        .otherwise("other")
    )


def route_score(wanted: Column, route: Column) -> Column:
    """Exact .35, prefix .12, same parent -.18, else -.30."""
    clean = lambda c: F.rtrim(F.lower(c), F.lit("/"))
    w, r = clean(wanted), clean(route)
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    return F.when(w == r, 0.35).when(F.startswith(r, F.concat(w, F.lit("/"))) | F.startswith(w, F.concat(r, F.lit("/"))), 0.12).when(parent(w) == parent(r), -0.18).otherwise(-0.30)


def python_module(path: Column) -> Column:
    """The module name of a Python file, roots ``src`` and ``lib`` left out."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "(^|/)__init__$", "")
    return F.replace(F.regexp_replace(bare, "^(src|lib)/", ""), F.lit("/"), F.lit("."))


def signal_scores(hits: DataFrame, terms: DataFrame, signals: DataFrame) -> DataFrame:
    """Recalled signals scored again: the mean over the query's terms of 1.0 where the name
    or a token holds the term and 0.9 where the path does."""
    size = terms.groupBy("query_id").agg(F.count("*").alias("size"))
    live = signals.filter(F.col("deleted_at").isNull()).dropDuplicates(["signal_id"]).select("signal_id", F.lower(F.concat_ws(" ", "name", F.array_join(F.coalesce("tokens", F.array().cast("array<string>")), " "))).alias("hay"), F.lower("file_path").alias("path"))
    pairs = hits.select("query_id", "signal_id").join(live, "signal_id").join(terms, "query_id")
    held = F.when(F.contains("hay", "term"), 1.0).when(F.contains("path", "term"), 0.9).otherwise(0.0)
    return pairs.groupBy("query_id", "signal_id").agg(F.sum(held).alias("held")).join(size, "query_id").select("query_id", "signal_id", F.round(F.col("held") / F.col("size"), 6).alias("score"))


def repository_profile(files: DataFrame, signals: DataFrame) -> DataFrame:
    """Per repository its five commonest languages and its most telling files as lists."""
    from brindle.operators.lookup import profile_files, top_counts

    languages = top_counts(files.select("repo_key", F.lower("language").alias("language")).dropna(), "repo_key", "language", 5)
    listed = languages.groupBy("repo_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "language"))), lambda x: x["language"]), ",").alias("languages"))
    telling = profile_files(files, signals, 3).groupBy("repo_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]), ",").alias("files"))
    return listed.join(telling, "repo_key", "full_outer")


def query_variants(query: Column, most: int = 4) -> Column:
    """The query and rewrites of it, at most 256 characters, no two alike but for case."""
    tokens = distinct_lower(identifier_tokens(query))
    forms = F.array(F.trim(query), F.array_join(tokens, " "), F.array_join(F.filter(tokens, lambda t: F.length(t) >= 4), " "))
    kept = F.filter(F.transform(forms, lambda f: F.substring(F.lower(F.trim(f)), 1, 256)), lambda f: f != "")
    return F.slice(F.array_distinct(kept), 1, most + 1)
