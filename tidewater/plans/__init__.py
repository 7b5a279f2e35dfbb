"""Registered queries over the driver's tables, with the SQL of their results."""

from tidewater.plans import cohort_queries, evaluation_queries, feature_queries, model_queries  # noqa: F401
from tidewater.plans.bindings import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
