"""Registered queries over the given tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from lexmill.plans import basic, texts

QUERIES: dict = basic.QUERIES | texts.QUERIES
ORACLE_SQL: dict[str, str] = basic.SQL | texts.SQL
FLAGSHIP = "g2_reconcile"
