"""All queries by name, with their SQL."""

from __future__ import annotations

from .plans import articles_plans, events, feature_plans, io_plans, metrics_plans, records, rules_plans, spatial_plans  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
