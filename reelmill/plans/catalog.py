"""Queries of the library and the SQL each must agree with."""

from __future__ import annotations

from . import matching, media, ordering, summaries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
