"""Queries on sentence units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.sentences import sentence_units
from brindle.sources.tables import table


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(table(spark, d, "documents")).select("doc_id", "end_pos")


def p10_unit_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Units, and their mean length in code points, per document."""
    return sentence_units(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("units"), F.round(F.avg(F.col("end_pos") - F.col("start_pos")), 2).alias("mean_length"))


QUERIES = {"p10_found": p10_found, "p10_unit_lengths": p10_unit_lengths}
ORACLES: dict[str, str] = {}
