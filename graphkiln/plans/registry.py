"""All registered queries with their SQL."""

from __future__ import annotations

from graphkiln.plans import doc_queries, eval_queries, graph_queries, more_queries, property_queries, reasoning_queries, run_queries, search_queries, step_queries, text_queries, vector_queries

MODULES = (graph_queries, search_queries, text_queries, vector_queries, eval_queries, doc_queries, more_queries, step_queries, reasoning_queries, property_queries, run_queries)


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.ORACLES
    return found


def flagship(spark, sf_dir):
    return graph_queries.resolve_and_rewire(spark, sf_dir)
