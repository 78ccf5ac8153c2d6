"""Registry of the operators' queries; importing the query modules fills it."""

from sitefold.llm.registry import ORACLES, QUERIES
from sitefold.llm import (  # noqa: F401  (registers queries)
    query_dedup,
    query_filters,
    query_layout,
    query_manifest,
    query_search,
    query_text,
)

__all__ = ["ORACLES", "QUERIES"]
