"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from brindle.llm import queries_basic, queries_files, queries_leakage, queries_mixing, queries_sentences, queries_vectors

MODULES = (queries_basic, queries_files, queries_leakage, queries_mixing, queries_sentences, queries_vectors)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
