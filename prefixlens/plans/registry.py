"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from prefixlens.plans import analysis_queries, analysis_sql, function_queries, problems, stream_queries

FLAGSHIP = "prefix_reuse_by_session"
QUERIES = {**analysis_queries.QUERIES, **function_queries.QUERIES, **problems.QUERIES, **stream_queries.QUERIES}
SQL = {**analysis_sql.SQL, **function_queries.SQL, **problems.SQL, **stream_queries.SQL}
