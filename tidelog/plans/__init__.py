"""Whole jobs over stored tables, and the registered queries with their SQL counterparts."""

from tidelog.plans import (  # noqa: F401
    alert_queries,
    ops_queries,
    parse_queries,
    rollup_queries,
    store_queries,
)
from tidelog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
