"""All registered queries and their SQL."""

from __future__ import annotations

from symtrace.plans import archive, measures, search

QUERIES: dict = archive.QUERIES | search.QUERIES | measures.QUERIES
ORACLE_SQL: dict = archive.ORACLE_SQL | search.ORACLE_SQL | measures.ORACLE_SQL
FLAGSHIP = "grid_roundtrip"
