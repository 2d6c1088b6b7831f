"""End-to-end plans and the registered queries."""

from . import (  # noqa: F401
    catalog_queries,
    chunk_queries,
    evaluation_queries,
    flagship_queries,
    fusion_queries,
    health_queries,
    pair_queries,
    wave_queries,
)
from .registry import ORACLES, QUERIES, ROWS

__all__ = ["ORACLES", "QUERIES", "ROWS"]
