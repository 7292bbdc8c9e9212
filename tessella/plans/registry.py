"""Registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from tessella.plans import case_queries, expression_queries, page_queries, relation_queries, service_queries

FLAGSHIP = "dg5_verdict"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (page_queries, expression_queries, relation_queries, service_queries, case_queries):
    for _name, (_query, _sql) in _part.ENTRIES.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLE_SQL[_name] = _sql
