"""All registered catalogue queries with their oracles."""

from __future__ import annotations

from shelfmark.functions import scalars  # noqa: F401
from shelfmark.operators import browse, collection_sets, dashboards, diagnostics, pair_models, predicates, preference, scans, scoring, sessions, similarity  # noqa: F401
from shelfmark.streaming import incremental, stateful  # noqa: F401
from shelfmark.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "flagship_scored_categories"
