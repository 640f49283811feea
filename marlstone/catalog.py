"""Every query of the engine's own operators, and the SQL that states its result."""

from __future__ import annotations

from marlstone.plans import queries_matching, queries_more, queries_statistics  # noqa: F401 - register their queries
from marlstone.plans.queries import ORACLES, QUERIES

#: The query that ``entry`` runs.
FLAGSHIP = "screen_status"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
