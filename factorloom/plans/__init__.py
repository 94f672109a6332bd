"""Registered queries, one module per section of the operator inventory."""

from factorloom.plans import (aggregates, joins, plugins, portfolio, reshape, scalars, selection, sinks, sources, streams,  # noqa: F401
                              styles, walkforward, windows)
from factorloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
