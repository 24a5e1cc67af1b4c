"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from tidemark.plans import lifecycle, reports, state

QUERIES: dict = {**state.QUERIES, **reports.QUERIES, **lifecycle.QUERIES}
ORACLE_SQL: dict[str, str] = {**state.ORACLE_SQL, **reports.ORACLE_SQL, **lifecycle.ORACLE_SQL}
