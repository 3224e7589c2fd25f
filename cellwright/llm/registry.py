"""Queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from cellwright.llm import canonical_queries, cluster_queries, corpus_queries, sentence_queries, term_queries, vector_queries

_ALL = (vector_queries, term_queries, canonical_queries, cluster_queries, corpus_queries, sentence_queries)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _ALL for k, s in m.ORACLES.items()}
