"""Check queries over the given tables, each with a DuckDB oracle where SQL can say it."""

from checks.registry import ORACLES, QUERIES
from checks import expressions, job_queries, page_queries, relational  # noqa: F401  (registers queries)

__all__ = ["ORACLES", "QUERIES"]
