"""All queries of the library, by name, with the SQL each is held against."""

from __future__ import annotations

from stratalens.plans import cluster_queries, geo_queries, io_queries, rel_queries, text_queries, vec_queries  # noqa: F401  they register on import
from stratalens.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
