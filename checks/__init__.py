"""Registered queries over the test tables, each paired with a SQL oracle."""

from checks import grid, labels, pipelines, points, readers, registry_ops, sampling, scoring, vector  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
