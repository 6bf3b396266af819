"""All queries of the library and their SQL."""

from __future__ import annotations

from . import documents, formats, pieces, rasters, spatial

MODULES = (spatial, documents, rasters, pieces, formats)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
