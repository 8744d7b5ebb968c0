"""All queries of the comparison engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pagelattice.plans import layout_queries, other_queries, picture_queries, run_queries, text_queries

PARTS = (text_queries, layout_queries, other_queries, picture_queries, run_queries)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
