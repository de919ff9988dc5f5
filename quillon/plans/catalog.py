"""All queries of the engine: importing this fills the registry."""

from __future__ import annotations

from quillon.plans import aggregations, composites, curation, evaluation, joins, records, routing, scans, searching, sequencing
from quillon.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregations", "composites", "curation", "evaluation", "joins", "records", "routing", "scans", "searching", "sequencing"]
