"""All registered queries and SQL counterparts of the library, without the training-data operators."""

from __future__ import annotations

from lodestone import queries_changes, queries_more, queries_records, queries_records_sql, queries_search, queries_semantic, queries_store

MODULES = (queries_search, queries_semantic, queries_records, queries_more, queries_store, queries_changes)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in (queries_search, queries_semantic, queries_records_sql, queries_more, queries_store, queries_changes) for k, v in m.ORACLES.items()}
