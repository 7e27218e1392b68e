"""All registered queries and oracle texts."""

from . import config_queries, item_queries, result_queries, source_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
