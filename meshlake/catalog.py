"""All queries for the engine's own operators, and their SQL twins."""

from __future__ import annotations

from .plans import composed_queries, line_queries, linear_queries, mesh_queries, raster_queries, scalar_queries, shape_queries  # noqa: F401
from .plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
