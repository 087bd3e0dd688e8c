"""All queries by name, and the SQL that states the same."""

from __future__ import annotations

from skylattice.plans import itinerary_queries, rule_queries, schedule_queries  # noqa: F401
from skylattice.plans.queries import ORACLES, QUERIES  # noqa: F401
