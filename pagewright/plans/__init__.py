"""All queries of the package by name."""

from pagewright.plans import flow_queries, layout_queries, more_queries, page_queries, record_queries, service_queries, state_queries
from pagewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flow_queries", "layout_queries", "more_queries", "page_queries", "record_queries", "service_queries", "state_queries"]
