"""One ranking from several differently-scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = ("lexical", "path_symbol", "direct_text_hits", "semantic")
#: The constant added to each rank.
RRF_K = 60


def _number(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def score_columns() -> dict[str, Column]:
    """The six scores of a candidate; null where missing or NaN."""
    return {"score": _number(F.col("score")), "rerank_score": _number(F.col("rerank_score"))} | {p: _number(F.element_at("score_parts", F.lit(p))) for p in PARTS}


def ranks(values: DataFrame, hot: int, pieces: int) -> DataFrame:
    """Standing of each ``value`` among those of its ``query_id, metric``, largest first,
    equal values alike.

    Values are counted first, so equal ones are one row. A group of more than ``hot``
    distinct values is cut at approximate quantiles into ``pieces`` ranges that are
    ranked apart and shifted by the number of candidates in the ranges above, so no
    task ever sorts a whole hot group; the quantiles only place the cuts, ranks are exact.
    """
    group = ["query_id", "metric"]
    counted = values.groupBy(*group, "value").agg(F.count("*").alias("same"))
    steps = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cuts = counted.groupBy(*group).agg(F.count("*").alias("size"), F.percentile_approx("value", steps, 1000).alias("cuts"))
    cuts = cuts.select(*group, F.when(F.col("size") > hot, F.col("cuts")).otherwise(F.array().cast("array<double>")).alias("cuts"))
    placed = counted.join(cuts, group).withColumn("piece", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    above = Window.partitionBy(*group).orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy(*group, "piece").agg(F.sum("same").alias("held")).withColumn("shift", F.coalesce(F.sum("held").over(above), F.lit(0))).drop("held")
    inside = Window.partitionBy(*group, "piece").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(shift, [*group, "piece"]).select(*group, "value", (F.col("shift") + F.coalesce(F.sum("same").over(inside), F.lit(0)) + 1).alias("rank"))


def fused_ranking(candidates: DataFrame, k: int = RRF_K, hot: int | None = None, pieces: int = 64) -> DataFrame:
    """Candidates with their ranks and fused score:
    ``query_id, chunk_id, rank_<score>..., fused``.

    Each of the six scores ranks the distinct candidates of a query, largest first;
    equal values share a rank, and null, missing or NaN values all stand after the
    last value. ``fused`` is the sum of ``1 / (k + rank)``, rounded to 12 digits so
    that the order of addition does not matter. Rows that repeat a candidate count
    once; if they differ, the larger value of each score holds. Candidates without a
    query or chunk id are left out; an empty table gives no rows.

    With ``hot=None`` the size of the largest query is looked up; only if it exceeds
    a million candidates are groups cut into pieces (see ``ranks``).
    """
    scores = score_columns()
    known = candidates.filter(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull())
    distinct = known.groupBy("query_id", "chunk_id").agg(*[F.max(c).alias(name) for name, c in scores.items()])
    if hot is None:
        largest = known.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
        hot = 1_000_000 if largest > 1_000_000 else 0
    if not hot:
        ranked = distinct
        for name in scores:
            ranked = ranked.withColumn(f"rank_{name}", F.rank().over(Window.partitionBy("query_id").orderBy(F.col(name).desc_nulls_last())))
    else:
        metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in scores])
        long = distinct.select("query_id", "chunk_id", F.explode(metrics).alias("m")).select("query_id", "chunk_id", "m.*")
        known_ranks = ranks(long.filter(F.col("value").isNotNull()), hot, pieces)
        last = long.groupBy("query_id", "metric").agg((F.count("value") + 1).alias("last"))
        joined = long.join(known_ranks, ["query_id", "metric", "value"], "left").join(last, ["query_id", "metric"])
        placed = joined.withColumn("rank", F.coalesce("rank", "last"))
        ranked = placed.groupBy("query_id", "chunk_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("rank"))).alias(f"rank_{m}") for m in scores])
    total = sum((1 / (F.lit(float(k)) + F.col(f"rank_{name}")) for name in scores), F.lit(0.0))
    return ranked.select("query_id", "chunk_id", *[F.col(f"rank_{name}").cast("bigint").alias(f"rank_{name}") for name in scores], F.round(total, 12).alias("fused"))


def leading(ranking: DataFrame, top: int = 5) -> DataFrame:
    """The first ``top`` candidates of each query by ``fused``, ties by chunk id.
    Spark keeps only ``top`` rows of a query per task before it shuffles them."""
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "chunk_id")
    return ranking.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)
