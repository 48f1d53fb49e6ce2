"""All market queries and their SQL."""

from __future__ import annotations

from basalt.plans import more_queries, oracle, queries, raw_queries

QUERIES = queries.QUERIES | more_queries.QUERIES | raw_queries.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | more_queries.ORACLE_SQL | raw_queries.ORACLE_SQL
