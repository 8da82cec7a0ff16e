"""All queries of the core."""

from graphloom.plans import audit_queries, fusion_queries, more_queries, reference_checks, release_queries, source_queries, text_queries

_MODULES = (reference_checks, text_queries, fusion_queries, release_queries, source_queries, more_queries, audit_queries)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

flagship = fusion_queries.flagship
