"""Registered queries; importing this package fills the registry."""

from candlewick.plans import bar_queries, grid_queries, history_queries, indicator_queries, log_queries, metric_queries, score_queries, trade_queries  # noqa: F401
from candlewick.plans.registry import ORACLES, QUERIES  # noqa: F401
