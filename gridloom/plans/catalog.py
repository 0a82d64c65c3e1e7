"""All registered queries and their SQL."""

from __future__ import annotations

from gridloom.plans import checks, panels, tables  # noqa: F401  they register their queries
from gridloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

#: A seasonal forecast scored on the last week of the daily panel: scan, aggregate, windows, folds and joins in one plan.
FLAGSHIP = "point_metrics"
