"""Queries that run the operators on the driver's tables, with their SQL."""

from . import closure_queries, component_queries, coverage_queries, dead_code_queries, extension_queries, finding_queries, graph_queries, health_queries, lookup_queries, provenance_queries, queries, resolution_queries, result_queries, scan_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
