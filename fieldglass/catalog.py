"""Every registered query and its SQL, by name."""

from __future__ import annotations

from .plans import rate_queries, sequence_queries, track_queries  # noqa: F401  they register themselves
from .plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
