"""Registered queries of the time-series and text operators, with their DuckDB SQL."""

from __future__ import annotations

from .plans import checks, evaluation, joins, models, news, reports, series  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
