"""The queries over the driver's tables and their SQL."""

from __future__ import annotations

from .plans import delineation, drainage, farming, hydro, kernels, management, stations, subareas, zones  # noqa: F401  (they register themselves)
from .plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
