"""Queries on mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.mixing import mix_report, mix_sources
from brindle.sources.tables import table


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every mix with their copies."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by every mix."""
    return mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_grown(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by mixes of three times the size that exact targets allow: the
    exponent gives way as far as repetition demands."""
    return mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"), growth=3.0)


def p9_even(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by mixes whose entropy is 0.9 of the greatest, whatever the targets."""
    return mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"), evenness=0.9)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_grown": p9_grown, "p9_even": p9_even}
ORACLES: dict[str, str] = {}
