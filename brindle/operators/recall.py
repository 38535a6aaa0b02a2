"""Candidate recall for a set of queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions.text import distinct_lower, folded, identifier_tokens
from brindle.operators.chunking import token_lists
from brindle.operators.matching import contained
from brindle.operators.sums import best_sums
from brindle.session import cut_lineage

LIMIT = 80
K1, B = 1.2, 0.75


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term``: the distinct tokens of each query."""
    return queries.select("query_id", F.explode(distinct_lower(identifier_tokens(F.col("query_text")))).alias("term")).distinct()


def scored_postings(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """``term, key, bm25`` of the texts that hold a term of any query (k1 1.2, b 0.75): the
    score of a term in a text is the same for every query.

    Of the tokens only those of query terms go beyond the task that reads a text: the distinct
    terms, part of the stated request, are sent to it. Texts are taken apart once; a text that has
    tokens is counted, with its length, by a row of the term "", which no token is."""
    tokens = token_lists(texts, key, text)
    asked = terms.select("term").unionByName(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
    marked = F.concat(F.when(F.size("tokens") > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), "tokens")
    rows = tokens.select(key, F.size("tokens").alias("length"), F.explode(marked).alias("term")).join(F.broadcast(asked), "term", "left_semi")
    length = F.when(F.col("term") == "", F.sum("length")).otherwise(F.first("length"))
    rows = cut_lineage(rows.groupBy("term", key).agg(F.count("*").alias("tf"), length.alias("length")))
    hits = rows.filter(F.col("term") != "")
    per_term = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))
    stats = rows.filter(F.col("term") == "").agg(F.sum("tf").alias("n"), (F.sum("length") / F.sum("tf")).alias("mean"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    joined = hits.join(per_term, "term").join(F.broadcast(stats))  # one row
    return joined.select("term", key, F.round(idf * saturated, 8).alias("bm25"))


def top(rows: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("position") <= limit).drop("position")


def _exact_sum(rounded: Column | str) -> Column:
    """A sum of numbers of eight digits that does not depend on their order."""
    c = F.col(rounded) if isinstance(rounded, str) else rounded
    return F.sum(c.cast("decimal(18,8)")).cast("double")


def lexical_all(scored: DataFrame, terms: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """Texts with every term of the query, best ``limit`` by BM25: ``query_id, key, score``.
    The score ``1 / (1 + bm25)`` falls with relevance while the cut goes by relevance."""
    weights = scored.select("term", key, F.rint(F.col("bm25") * 100_000_000).cast("bigint").alias("weight"))
    best = best_sums(terms, weights, key, limit, every=True, unit=100)
    return best.select("query_id", key, F.round(1 / (1 + F.col("total") / 1_000_000), 8).alias("score"))


def lexical_any(scored: DataFrame, terms: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """Every term alone, best ``limit`` texts each; scores add up per text; best ``limit``.
    The best of a term are cut out once, however many queries ask for it."""
    per_term = top(scored, "term", [F.desc("bm25"), key], limit)
    summed = terms.join(per_term, "term").groupBy("query_id", key).agg(F.round(_exact_sum(F.round(1 / (1 + F.abs("bm25")), 8)), 6).alias("score"))
    return top(summed, "query_id", [F.desc("score"), key], limit)


def lexical(texts: DataFrame, text: str, queries: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """All terms where some text has them all, else any: ``query_id, key, score, form``."""
    terms = query_terms(queries)
    scored = scored_postings(texts, key, text, terms)
    whole = lexical_all(scored, terms, key, limit).withColumn("form", F.lit("all"))
    rest = terms.join(whole.select("query_id").distinct(), "query_id", "left_anti")
    return whole.unionByName(lexical_any(scored, rest, key, limit).withColumn("form", F.lit("any")))


def path_symbol(terms: DataFrame, files: DataFrame, symbols: DataFrame, tokens: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per path and query term the best of: path holds the term 1.0, a symbol name holds it
    1.0, equal token 0.25; summed per path; best ``limit``.

    ``files`` has ``path``, ``symbols`` ``path, name``, ``tokens`` ``path, term``. Holding is
    tested once per distinct path and name with one automaton of all terms.
    """
    distinct_terms = terms.select("term").distinct()

    def holding(names: DataFrame, column: str) -> DataFrame:
        lowered = names.select(column).dropna().distinct().withColumn("_low", F.lower(column))
        return contained(lowered, column, "_low", distinct_terms, "term").withColumnRenamed("probe", "term")

    by_path = holding(files, "path").select("path", "term", F.lit(1.0).alias("hit"))
    by_name = symbols.select("path", "name").distinct().join(holding(symbols, "name"), "name").select("path", "term", F.lit(1.0).alias("hit"))
    by_token = tokens.select("path", "term").join(distinct_terms, "term").select("path", "term", F.lit(0.25).alias("hit"))
    best = by_path.unionByName(by_name).unionByName(by_token).groupBy("path", "term").agg(F.max("hit").alias("hit"))
    quarters = best.select("path", "term", (F.col("hit") * 4).cast("bigint").alias("weight"))
    return best_sums(terms, quarters, "path", limit).select("query_id", "path", (F.col("total") / 4).alias("score"))


def direct_score(hits: Column, strong: Column, probes: Column) -> Column:
    """Without a strong hit at most half; with one at least 0.6."""
    share = hits / F.least(probes, F.lit(6))
    return F.when(~strong, F.least(F.lit(0.5), share)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.6), share)))


def direct_text(probes: DataFrame, texts: DataFrame, key: str, limit: int) -> DataFrame:
    """Literal probes in ``text``, case-folded: ``query_id, key, hits, score``. ``probes`` has
    ``query_id, probe``. A probe of 8 characters, or 4 CJK ones, is strong."""
    folded_probes = probes.select("query_id", folded(F.col("probe")).alias("probe")).distinct()
    counts = folded_probes.groupBy("query_id").agg(F.count("*").alias("probes"))
    single = folded_probes.select("probe").distinct().withColumn("strong", (F.length("probe") >= 8) | F.col("probe").rlike("[\\u3400-\\u9fff]{4}"))
    found = contained(texts.select(key, folded(F.col("text")).alias("text")), key, "text", single, "probe").join(single, "probe")
    per_text = folded_probes.join(found, "probe").groupBy("query_id", key).agg(F.count("*").alias("hits"), F.max("strong").alias("strong")).join(counts, "query_id")
    scored = per_text.select("query_id", key, "hits", F.round(direct_score(F.col("hits"), F.col("strong"), F.col("probes")), 6).alias("score"))
    return top(scored, "query_id", [F.desc("score"), F.desc("hits"), key], limit)


def signal_recall(terms: DataFrame, signals: DataFrame, limit: int) -> DataFrame:
    """Recallable live signals by the number of query terms held in name, tokens or
    metadata; endpoints first among equals: ``query_id, signal_id, hits``."""
    metadata = F.array_join(F.concat(F.map_keys("metadata"), F.map_values("metadata")), " ")
    hay = F.lower(F.concat_ws(" ", "name", F.array_join(F.coalesce("tokens", F.array().cast("array<string>")), " "), metadata))
    live = signals.filter(F.col("recallable") & F.col("deleted_at").isNull()).select("signal_id", "kind", "start_line", "end_line", "name", hay.alias("hay")).dropDuplicates(["signal_id"])
    held = contained(live, "signal_id", "hay", terms, "term").withColumnRenamed("probe", "term")
    first = F.when(F.col("kind") == "endpoint", 0).otherwise(1)
    ordered = held.join(live.drop("hay").withColumn("first", first), "signal_id").withColumn("weight", F.lit(1).cast("bigint"))
    best = best_sums(terms, ordered, "signal_id", limit, ["first", "start_line", "end_line", "kind", "name"])
    return best.select("query_id", "signal_id", F.col("total").alias("hits"))


def exact_vectors(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The ``k`` vectors of largest cosine for every query vector, exactly:
    ``query_id, vec_id, cosine``. Both have ``vector``; a query does not find itself.

    The queries are the stated set and go to every task in blocks of ``block``, each a
    matrix product per batch of vectors; a task keeps ``k`` per query, so what is merged
    is small. Zero or not finite vectors have cosine 0.
    """
    spark = vectors.sparkSession
    found = None
    rows, ids = [], []

    def unit(matrix: np.ndarray) -> np.ndarray:
        matrix = np.where(np.isfinite(matrix), matrix, 0.0)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def search(query_ids: np.ndarray, query_unit: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                if len(batch) == 0:
                    continue
                own = batch["vec_id"].to_numpy()
                near = np.round(query_unit @ unit(np.stack(batch["vector"].to_numpy()).astype(np.float64)).T, 6)
                near[query_ids[:, None] == own[None, :]] = -2
                scores = near if best is None else np.concatenate([best[0], near], axis=1)
                names = np.broadcast_to(own, near.shape) if best is None else np.concatenate([best[1], np.broadcast_to(own, near.shape)], axis=1)
                order = np.lexsort((names, -scores), axis=1)[:, :k]
                best = (np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1))
            if best is not None:
                part = pd.DataFrame({"query_id": np.repeat(query_ids, best[0].shape[1]), "vec_id": best[1].ravel(), "cosine": best[0].ravel()})
                yield part[part["cosine"] > -2]

        return vectors.select("vec_id", "vector").mapInPandas(run, "query_id bigint, vec_id bigint, cosine double")

    def take() -> None:
        nonlocal found
        one = search(np.array(ids), unit(np.array(rows, dtype=np.float64)))
        found = one if found is None else found.unionByName(one)

    for row in queries.select("query_id", "vector").dropna().toLocalIterator():
        ids.append(row[0])
        rows.append(row[1])
        if len(ids) == block:
            take()
            rows, ids = [], []
    if ids:
        take()
    if found is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, cosine double")
    return top(found, "query_id", [F.desc("cosine"), "vec_id"], k)


def variant_vectors(variants: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of every variant of every query: ``query_id, vec_id, variant, source,
    cosine``. ``variants`` has ``query_id, variant, source, vector``; the source ``original``
    gives evidence of the key ``semantic``, any other ``planner_semantic``. A variant whose
    vector is null is left out, as one that could not be embedded."""
    numbered = variants.filter(F.col("vector").isNotNull()).select("query_id", "variant", "source", "vector", F.xxhash64("query_id", "variant").alias("_key"))
    found = exact_vectors(numbered.select(F.col("_key").alias("query_id"), "vector"), vectors, k).withColumnRenamed("query_id", "_key")
    key = F.when(F.col("source") == "original", "semantic").otherwise("planner_semantic")
    return found.join(numbered.drop("vector"), "_key").select("query_id", "vec_id", "variant", key.alias("source"), "cosine")


def merged_matches(matches: DataFrame) -> DataFrame:
    """Per query and vector the best cosine of each source, and its matches by variant, best
    first: ``query_id, vec_id, semantic, planner_semantic, variants``. A variant that was
    searched twice counts with its better match."""
    best = matches.groupBy("query_id", "vec_id", "variant", "source").agg(F.max("cosine").alias("cosine"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("o"), "variant"))), lambda m: m["variant"])
    of = lambda s: F.max(F.when(F.col("source") == s, F.col("cosine"))).alias(s)
    return best.groupBy("query_id", "vec_id").agg(of("semantic"), of("planner_semantic"), ordered.alias("variants"))


def hint_parts(hints: DataFrame, texts: DataFrame, files: DataFrame, symbols: DataFrame, tokens: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Recall by the hints of a planner: ``query_id, path, key, value`` with the keys
    ``planner_lexical`` and ``planner_path_symbol``. ``hints`` has ``query_id, term``;
    ``texts`` has ``path, text``; the rest as in ``path_symbol``."""
    scored = scored_postings(texts, "path", "text", hints)
    whole = cut_lineage(lexical_all(scored, hints, "path", limit))  # read twice
    rest = hints.join(whole.select("query_id").distinct(), "query_id", "left_anti")
    lexical_rows = whole.unionByName(lexical_any(scored, rest, "path", limit)).select("query_id", "path", F.lit("planner_lexical").alias("key"), F.col("score").alias("value"))
    named = path_symbol(hints, files, symbols, tokens, limit).select("query_id", "path", F.lit("planner_path_symbol").alias("key"), F.col("score").alias("value"))
    return lexical_rows.unionByName(named)


def in_scope(files: DataFrame, include: list[str], exclude: list[str], languages: list[str], code_only: bool, non_code: list[str]) -> DataFrame:
    """The hard filter before every recall: path patterns as regular expressions, languages, code only."""
    language = F.lower("language")
    wanted = F.lit(True)
    if include:
        wanted = wanted & F.col("path").rlike("|".join(f"(?:{p})" for p in include))
    if exclude:
        wanted = wanted & ~F.col("path").rlike("|".join(f"(?:{p})" for p in exclude))
    if languages:
        wanted = wanted & language.isin(*languages)
    if code_only:
        wanted = wanted & (language.isNull() | ~language.isin(*non_code))
    return files.filter(wanted)


def merge_evidence(parts: DataFrame, group: list[str]) -> DataFrame:
    """Evidence of one candidate from several sources: ``group, score, parts``. ``parts`` has
    ``group, score, key, value``; of a key the largest value holds, of a penalty the
    smallest; of keys ``graph_*`` only the one with the largest value, then first name."""
    penalty = (F.col("key") == "penalty") | F.endswith(F.col("key"), F.lit("_penalty"))
    merged = parts.groupBy(*group, "key").agg(F.max("score").alias("score"), F.when(F.first(penalty), F.min("value")).otherwise(F.max("value")).alias("value"))
    graph = F.startswith(F.col("key"), F.lit("graph_"))
    entries = F.collect_list(F.when(~graph, F.struct("key", "value")))
    strongest = F.min(F.when(graph, F.struct((-F.col("value")).alias("order"), "key", "value")))
    rows = merged.groupBy(*group).agg(F.max("score").alias("score"), entries.alias("entries"), strongest.alias("graph"))
    kept = F.when(F.col("graph").isNotNull(), F.array(F.struct(F.col("graph.key").alias("key"), F.col("graph.value").alias("value")))).otherwise(F.slice("entries", 1, 0))
    return rows.select(*group, "score", F.map_from_entries(F.concat("entries", kept)).alias("parts"))
