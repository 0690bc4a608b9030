"""The registered queries over the driver's tables."""

from __future__ import annotations

from . import corpus_queries, page_queries, series_queries, text_queries

_MODULES = (text_queries, corpus_queries, series_queries, page_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
