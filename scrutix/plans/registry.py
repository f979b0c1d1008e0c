"""All queries but those of the optional subpackage, and their SQL."""

from __future__ import annotations

from . import other_queries, text_queries

_MODULES = (text_queries, other_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
