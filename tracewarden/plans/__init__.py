"""Queries over the driver's tables; importing the modules fills the registry."""

from __future__ import annotations

from . import artifact_queries, catalog_queries, finding_queries, flow_queries, pack_queries, program_queries, record_queries, report_queries, rule_queries, rule_table_queries, run_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "artifact_queries", "catalog_queries", "finding_queries", "flow_queries", "pack_queries", "program_queries", "record_queries", "report_queries", "rule_queries", "rule_table_queries", "run_queries"]
