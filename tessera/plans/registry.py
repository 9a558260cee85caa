"""Every named query of the package, with the SQL that states the same result."""

from __future__ import annotations

from tessera.plans import catalog, contracts, control, formats, readers, scoring, streams, text

_MODULES = (scoring, catalog, control, text, formats, contracts, streams, readers)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
