"""Registered queries of the analytics operators and their DuckDB twins."""

from __future__ import annotations

from . import grid_queries, physics_queries, reliability_queries, report_queries, run_queries, source_queries, statistics_queries, tabular_queries

_PARTS = (tabular_queries, grid_queries, run_queries, report_queries, physics_queries, statistics_queries, reliability_queries, source_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
