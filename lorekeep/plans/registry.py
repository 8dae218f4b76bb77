"""All queries of the library and their SQL."""

from __future__ import annotations

from lorekeep.plans import clause_queries, extraction_queries, graph_queries, inference_queries, ledger_queries, meaning_queries, people_queries, places_queries, revision_queries, timeline_queries, vector_queries

_PARTS = (clause_queries, graph_queries, ledger_queries, timeline_queries, vector_queries, inference_queries, extraction_queries, people_queries, revision_queries, places_queries, meaning_queries)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: q for part in _PARTS for name, q in part.ORACLES.items()}
