"""All core queries and their SQL."""

from __future__ import annotations

from brindle.plans import anchor_queries, fact_queries, index_queries, integrity, ranking_queries, recall_queries, rerank_queries, text_queries

MODULES = (integrity, text_queries, recall_queries, index_queries, ranking_queries, anchor_queries, fact_queries, rerank_queries)
#: Twelve results per query: ranked, clamped, one per path.
FLAGSHIP = ranking_queries.f30_selected


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
