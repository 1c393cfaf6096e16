"""Every registered query of the library and its SQL. Groups add themselves in the modules listed below."""

from __future__ import annotations

from . import chart_queries, curation_queries, profile_queries, shaping_queries, store_queries

_GROUPS = [shaping_queries, chart_queries, profile_queries, curation_queries, store_queries]

QUERIES = {name: q for g in _GROUPS for name, q in g.QUERIES.items()}
ORACLE_SQL = {name: s for g in _GROUPS for name, s in g.ORACLE_SQL.items()}
