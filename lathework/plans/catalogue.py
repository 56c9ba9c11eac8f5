"""All queries of the library and their SQL."""

from __future__ import annotations

from . import core_queries, core_sql, reference_queries, reference_sql, suite_queries

QUERIES = {**core_queries.QUERIES, **reference_queries.QUERIES, **suite_queries.QUERIES}
SQL: dict[str, str] = {**core_sql.SQL, **reference_sql.SQL, **suite_queries.SQL}
