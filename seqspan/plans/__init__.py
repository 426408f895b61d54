"""The registered queries over the driver's tables, each with an equivalent DuckDB statement where one exists."""

from __future__ import annotations

from . import break_queries, carry_queries, census_queries, detect_queries, file_queries, frame_queries, interval_queries, job_queries, learn_queries, misc_queries, queue_queries, run_queries, segment_queries, text_queries

_FAMILIES = (frame_queries, interval_queries, run_queries, segment_queries, break_queries, census_queries, learn_queries, text_queries, job_queries, misc_queries, carry_queries, queue_queries, detect_queries, file_queries)
FLAGSHIP = "break_runs"


def queries():
    return {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql():
    return {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
