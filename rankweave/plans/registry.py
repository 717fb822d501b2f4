"""All registered queries of the relational operators, and their DuckDB SQL."""

from __future__ import annotations

from rankweave.plans import answers, chunks, evaluation, graph, retrieval, slots, sources, streams, text

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (retrieval, graph, text, chunks, evaluation, streams, sources, answers, slots):
    QUERIES |= module.plans.queries
    ORACLE_SQL |= module.plans.sql
