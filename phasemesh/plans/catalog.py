"""All registered queries of the library (those of optional subpackages are registered by them)."""

from __future__ import annotations

from . import complex_queries, motion_queries, source_queries, stats_queries

_ALL = {**motion_queries.QUERIES, **complex_queries.QUERIES, **stats_queries.QUERIES, **source_queries.QUERIES}

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
