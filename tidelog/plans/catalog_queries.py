"""All queries over the driver's tables, with their SQL, gathered from the modules beside this one."""

from __future__ import annotations

from . import log_queries, memory_queries, more_queries, search_queries, sql_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in (log_queries, sql_queries, search_queries, memory_queries, more_queries):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
