"""All queries of the core, and the SQL that checks them."""

from __future__ import annotations

from cellwright.plans import basic, expression, pipelines, proximity, segmentation, spatial

_BOOKS = (segmentation.book, basic.book, expression.book, spatial.book, pipelines.book)
FLAGSHIP = "seg_jaccard"
QUERIES = {**proximity.QUERIES, **{k: q for b in _BOOKS for k, q in b.queries.items()}}
ORACLES: dict[str, str] = {**proximity.ORACLES, **{k: s for b in _BOOKS for k, s in b.oracles.items()}}
