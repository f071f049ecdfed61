"""Queries over the driver's tables by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import catalog_frame, catalog_intervals, catalog_models, catalog_signal, catalog_sources, catalog_stats, catalog_stores

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (catalog_frame, catalog_intervals, catalog_signal, catalog_sources, catalog_stats, catalog_models, catalog_stores):
    QUERIES |= _part.CATALOG.queries
    ORACLES |= _part.CATALOG.oracles
