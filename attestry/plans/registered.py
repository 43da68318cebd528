"""All registered queries of the library and their SQL."""

from __future__ import annotations

from attestry.plans import claims_to_gate, evidence_steps, files_and_stores, more_tables, review_and_runs, search, streaming_queries, tables_and_text, whole_parts

_GROUPS = (claims_to_gate, tables_and_text, more_tables, evidence_steps, review_and_runs, streaming_queries, search, files_and_stores, whole_parts)
QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
ORACLE_SQL = {name: sql for group in _GROUPS for name, sql in group.ORACLE_SQL.items()}
