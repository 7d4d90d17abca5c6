"""The registered queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from . import cleaning, curation, modelling, relational  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
