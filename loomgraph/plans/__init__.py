"""All queries of the engine, and the SQL that states them again."""

from . import graph_queries, record_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph_queries", "record_queries"]
