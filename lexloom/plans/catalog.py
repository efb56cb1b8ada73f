"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from . import assoc_queries, detail_queries, series_queries, span_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
