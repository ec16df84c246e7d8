"""Registered queries over the test tables, each with its SQL twin."""

from kindred.plans import cleaning, evaluation, learning, linkage, mapping, sources  # noqa: F401
from kindred.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
