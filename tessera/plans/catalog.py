"""All queries of the map-feature and raster-field operators, with the SQL that checks them."""

from __future__ import annotations

from . import field_queries, geometry_queries, paint_queries, raster_queries, source_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
