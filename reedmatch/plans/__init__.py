"""Registered queries and, for each, SQL of the same result."""

from . import files, oracles, queries

QUERIES = queries.QUERIES | files.QUERIES
ORACLES = oracles.ORACLES | files.ORACLES

__all__ = ["ORACLES", "QUERIES"]
