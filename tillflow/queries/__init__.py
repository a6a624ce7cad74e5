"""Runnable queries over the given tables, each with its SQL oracle where SQL can say it."""

from . import basics, files, insight, logs, marts, quality, silver, stream, trends  # noqa: F401
from .registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES", "query", "table"]
