"""Queries on source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.handwritten import classify_files
from brindle.llm.syntax import check_files, invalid_rates
from brindle.sources.tables import table


def _origins(spark: SparkSession, d: str) -> DataFrame:
    return classify_files(table(spark, d, "source_files"), table(spark, d, "file_texts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d).filter(F.col("origin") != "handwritten").select("file_id")


def p2_origins(spark: SparkSession, d: str) -> DataFrame:
    """Files per suffix and origin."""
    return _origins(spark, d).groupBy("suffix", "origin").agg(F.count("*").alias("files"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return check_files(table(spark, d, "source_files"), table(spark, d, "file_texts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).filter(F.col("least_cost") > 0).select("file_id")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files per repository and language."""
    return invalid_rates(_checked(spark, d))


def p4_costs(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files by what is wrong, cost of the repair and whether the cost is proven."""
    invalid = _checked(spark, d).filter("invalid")
    return invalid.groupBy("suffix", "diagnosis", "edit_cost", F.coalesce(F.col("edit_cost") == F.col("least_cost"), F.lit(False)).alias("proven")).agg(F.count("*").alias("files"))


def p4_hints(spark: SparkSession, d: str) -> DataFrame:
    """How the reasons of skipped scans go with what the texts say."""
    hints = table(spark, d, "scan_skips").select("repo_key", "path", "reason").dropna().distinct()
    checked = _checked(spark, d)
    return checked.join(hints, ["repo_key", "path"]).groupBy("reason", "diagnosis").agg(F.count("*").alias("files"))


QUERIES = {"p2_found": p2_found, "p2_origins": p2_origins, "p4_found": p4_found, "p4_rates": p4_rates, "p4_costs": p4_costs, "p4_hints": p4_hints}
ORACLES: dict[str, str] = {}
