"""Score parts to ranks: combined score, evidence classes, ceilings, total order, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weights of the parts of the combined score.
WEIGHTS = {"lexical": 0.25, "planner_lexical": 0.12, "token_coverage": 0.20, "direct_text": 0.45, "anchored_relation": 0.75}
FULL = ("signal", "relation", "original_relation", "planner_relation")


def part(key: str) -> Column:
    """A part of the map ``score_parts``, 0 where missing or not a number."""
    value = F.element_at("score_parts", F.lit(key))
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)


def effective_semantic() -> Column:
    planner = part("planner_semantic")
    return F.greatest(part("semantic"), F.when(planner > 0, planner * 0.85).otherwise(0.0))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def combined_score() -> Column:
    """The linear score over all parts."""
    total = effective_semantic() * 0.55 + F.least(part("path_symbol"), F.lit(5.0)) / 5 * 0.15 + F.least(part("planner_path_symbol"), F.lit(5.0)) / 5 * 0.07 + clamp(part("planner_signal")) * 0.65
    for key, weight in WEIGHTS.items():
        total = total + part(key) * weight
    for key in FULL:
        total = total + clamp(part(key))
    graph = [part(f"graph_{k}_match") for k in ("calls", "implements", "uses_type", "imports", "routes_to", "mapped_by", "tests")]
    return total + clamp(F.greatest(*graph)) + part("penalty")


def max_normalised(value: Column, group: str) -> Column:
    """Shares of the largest value of the group; 0 if none is above 0; not finite is 0."""
    known = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
    largest = F.max(known).over(Window.partitionBy(group))
    return F.when(largest <= 0, 0.0).otherwise(F.greatest(known, F.lit(0.0)) / largest)


def evidence_priority(name: Column) -> Column:
    # Fixed values.
    order = {"original_direct": 0, "weak_original_direct": 1, "planner_direct": 1, "original_relation": 2, "planner_relation": 3}
    chain = F.lit(4)
    for key, value in order.items():
        chain = F.when(name == key, value).otherwise(chain)
    return chain


def ceiling_clamped(rows: DataFrame, group: str) -> DataFrame:
    """Rows of weaker evidence may not pass the weakest strong row of their query: adds
    ``ceiling, clamped, final_score``. One window over the query for all of them."""
    strong = F.min(F.when(F.col("evidence_priority") == 0, F.col("rerank_score"))).over(Window.partitionBy(group))
    with_ceiling = rows.withColumn("ceiling", strong * (1 - 1e-6))
    over = (F.col("evidence_priority") > 0) & F.col("ceiling").isNotNull() & (F.col("rerank_score") > F.col("ceiling"))
    return with_ceiling.withColumn("clamped", over).withColumn("final_score", F.when(F.col("clamped"), F.col("ceiling")).otherwise(F.col("rerank_score")))


def ordered(rows: DataFrame, group: str, keys: list) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*keys)))


def first_per_path(rows: DataFrame, group: str, path: str, most: int) -> DataFrame:
    """The best row of each path, then the best ``most`` paths of each query. ``rows`` has
    ``position`` within the query."""
    best = rows.groupBy(group, path).agg(F.min("position").alias("position"))
    kept = rows.join(best, [group, path, "position"])
    return ordered(kept, group, ["position"]).filter(F.col("position") <= most)


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or adjacent line spans of one key as one: ``keys, start_line, end_line,
    merged``. A running maximum of the ends tells where a gap begins."""
    order = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("gap", F.when(reach.isNull() | (F.col("start_line") > reach + 1), 1).otherwise(0)).withColumn("island", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("merged")).drop("island")


def context_window(start: Column, end: Column, lines: Column, before: int = 8, after: int = 12) -> Column:
    """Lines around a span, within the file."""
    return F.struct(F.greatest(F.lit(1), start - before).alias("start_line"), F.least(lines, end + after).alias("end_line"))


def token_coverage(query_tokens: Column, chunk_tokens: Column) -> Column:
    """Share of the query's tokens, repeats counted, that the chunk has."""
    held = F.size(F.filter(query_tokens, lambda t: F.array_contains(chunk_tokens, t)))
    return F.when(F.size(query_tokens) > 0, held / F.size(query_tokens)).otherwise(0.0)


def reasons(texts: dict[str, str]) -> Column:
    """Texts of the parts above 0, in the order given."""
    return F.array_compact(F.array(*[F.when(part(key) > 0, text) for key, text in texts.items()]))


def follow_up_terms(rows: DataFrame, group: str, tokens: str, stop: list[str], most: int = 12) -> DataFrame:
    """Commonest tokens of each query's results, without stop words, short ones and numbers."""
    words = rows.select(group, F.explode(tokens).alias("term")).withColumn("term", F.lower("term"))
    kept = words.filter((F.length("term") >= 3) & ~F.col("term").isin(*stop) & ~F.col("term").rlike("^[0-9]+$"))
    return ordered(kept.groupBy(group, "term").agg(F.count("*").alias("n")), group, [F.desc("n"), "term"]).filter(F.col("position") <= most)
