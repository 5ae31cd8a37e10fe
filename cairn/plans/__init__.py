"""Queries of the library over the driver's tables."""

from cairn.plans import feature_queries, metric_queries, model_queries, notebook_queries, prepared_queries, quality_queries  # noqa: F401
from cairn.plans.registry import ORACLES, QUERIES  # noqa: F401
