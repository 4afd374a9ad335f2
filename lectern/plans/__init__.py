"""Registered queries: one per operator, each with its SQL where SQL can state it."""

from lectern.plans import markup, relational, search, sources, streams, text, vectors  # noqa: F401
from lectern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
