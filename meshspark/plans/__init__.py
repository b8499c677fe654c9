"""Registered queries and the SQL that gives the same rows."""

from meshspark.plans import mesh_queries, more_queries, shape_queries, source_queries, space_queries, stream_queries, sweep_queries  # noqa: F401
from meshspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
