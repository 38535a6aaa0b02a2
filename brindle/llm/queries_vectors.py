"""Queries on nearest vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.forest import comparable_vectors, exact_nearest, nearest_vectors, similar_pairs
from brindle.sources.tables import table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return comparable_vectors(table(spark, d, "chunk_vectors"), table(spark, d, "embedding_configs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(nearest_vectors(_vectors(spark, d), k=5, least=0.88)).select("vec_id_a", "vec_id_b")


#: The stated query set of the searches.
ASKS = "vec_id % 50 = 0"


def p7_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of the stated query set against all rows, without loss, with
    their chunk ids."""
    vectors = _vectors(spark, d)
    chunk = vectors.select("space", "vec_id", "chunk_id").dropDuplicates(["space", "vec_id"])
    own = exact_nearest(vectors, ASKS, k=5).join(chunk, ["space", "vec_id"])
    other = chunk.withColumnsRenamed({"vec_id": "other", "chunk_id": "other_chunk_id"})
    return own.join(other, ["space", "other"]).select("space", "vec_id", "chunk_id", "other", "other_chunk_id", F.round("cosine", 6).alias("cosine"), "position")


def p7_recall(spark: SparkSession, d: str) -> DataFrame:
    """What the forest finds of the five nearest of the stated query set, per space: of all,
    and of those with a cosine of 0.88 or more."""
    vectors = _vectors(spark, d)
    true = exact_nearest(vectors, ASKS, k=5).select("space", "vec_id", "other", "cosine")
    # Strangers share short prefixes only: where they count too, the forest has to hold more.
    found = nearest_vectors(vectors, k=5, trees=16, candidates=40_000, keep=64, asks=ASKS).select("space", "vec_id", "other", F.lit(True).alias("found"))
    hit = F.coalesce("found", F.lit(False))
    close = F.col("cosine") >= 0.88
    return true.join(found, ["space", "vec_id", "other"], "left").groupBy("space").agg(
        F.count("*").alias("nearest"), F.count_if(hit).alias("found"), F.count_if(close).alias("close"), F.count_if(close & hit).alias("close_found")
    )


QUERIES = {"p7_found": p7_found, "p7_nearest": p7_nearest, "p7_recall": p7_recall}

ORACLES = {
    "p7_nearest": """
WITH named AS (
  SELECT config_hash AS space, vec_id, chunk_id, vector::DOUBLE[] AS vector
  FROM chunk_vectors JOIN embedding_configs USING (config_hash)
  WHERE vector IS NOT NULL AND vec_id IS NOT NULL AND len(vector) = dimensions
    AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.space, a.vec_id, a.chunk_id, b.vec_id AS other, b.chunk_id AS other_chunk_id, round(list_cosine_similarity(a.vector, b.vector), 12) AS cosine
  FROM named a JOIN named b ON a.space = b.space AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY space, vec_id ORDER BY cosine DESC, other) AS position FROM near)
SELECT space, vec_id, chunk_id, other, other_chunk_id, round(cosine, 6) AS cosine, position::INT AS position FROM ranked WHERE position <= 5"""
}
