"""Registered queries: name to callable, and name to SQL."""

from __future__ import annotations

from . import audit_queries, further_queries, matching_queries, more_queries, streaming_queries, text_queries

_MODULES = (matching_queries, audit_queries, text_queries, more_queries, further_queries, streaming_queries)


def queries() -> dict:
    return {f.__name__: f for m in _MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.sql().items()}
