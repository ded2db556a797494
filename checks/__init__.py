"""Every operator as a query over the given tables, next to the SQL that must give the same rows."""

from . import aggregates, learning, relational, scalars, streams  # noqa: F401 - importing registers the queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
