"""Every query of the engine with the SQL that gives the same rows."""

from __future__ import annotations

from dwell.plans import boxes, files, identity, presence, review, sampling, streams  # noqa: F401  (registers their queries)
from dwell.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
