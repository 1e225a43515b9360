"""All registered queries and their SQL."""

from tidemark import queries, queries_research, queries_sources  # noqa: F401

QUERIES = queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL
