"""Queries over the page-image views, and their SQL."""

from vellum.plans import contour_queries, drawing_queries, evaluation, export_queries, geometry, more_queries, pixel_queries, resample_queries, store, streams  # noqa: F401
from vellum.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
