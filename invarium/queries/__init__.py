"""All registered queries of the engine."""

from __future__ import annotations

from invarium.queries import events, mining, plans, relations, streams  # noqa: F401
from invarium.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
