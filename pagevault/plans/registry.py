"""Queries by name, each with the SQL that it is compared with."""

from . import events, learning, pages, retrieval

QUERIES = pages.QUERIES | events.QUERIES | retrieval.QUERIES | learning.QUERIES
ORACLES = pages.ORACLES | events.ORACLES | retrieval.ORACLES | learning.ORACLES

__all__ = ["ORACLES", "QUERIES"]
