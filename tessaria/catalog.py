"""All registered queries; the subpackage ``llm`` registers its own through the driver entry."""

from __future__ import annotations

from tessaria.queries import events, general, records

MODULES = [general, events, records]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for m in MODULES for name, sql in m.SQL.items()}
