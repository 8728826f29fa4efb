"""All queries and their SQL."""

from __future__ import annotations

from hopframe.plans import graph_queries, ingest_queries, kernel_queries, model_queries, qa_queries, split_queries

_MODULES = (graph_queries, ingest_queries, qa_queries, kernel_queries, model_queries, split_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
