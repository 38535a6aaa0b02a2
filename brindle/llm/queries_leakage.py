"""Queries on leaked evaluation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.leakage import answer_checks, leaked_items
from brindle.sources.tables import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("leaked").select("doc_id", "item_id")


def p8_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Leaks and likely paraphrases with the checks they rest on."""
    documents, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    pairs = leaked_items(documents, items).filter(F.col("leaked") | (F.col("common_share") >= 0.5))
    return answer_checks(pairs, documents, items).select("doc_id", "item_id", "longest_run", F.round("common_share", 4).alias("common_share"), "leaked", "answer_found")


QUERIES = {"p8_found": p8_found, "p8_pairs": p8_pairs}
ORACLES: dict[str, str] = {}
