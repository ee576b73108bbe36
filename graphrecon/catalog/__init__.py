"""Queries over the driver's tables: one per operator, with SQL that gives the same result."""

from graphrecon.catalog import classify, graphs, pairs, planning, reports, scoring, sources, topology  # noqa: F401
from graphrecon.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
