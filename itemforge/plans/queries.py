"""All queries of the library and their SQL."""

from __future__ import annotations

from itemforge.plans import bank_queries, catalogue, layout_queries  # noqa: F401 - each adds its own

QUERIES, ORACLE_SQL = catalogue.QUERIES, catalogue.ORACLE_SQL
