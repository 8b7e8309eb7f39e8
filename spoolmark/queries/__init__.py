"""Registry of the library's queries and of the SQL each is checked against."""

from __future__ import annotations

from spoolmark.queries import data_quality, formats, links, measures, structures

MODULES = [data_quality, links, measures, structures, formats]


def core_queries() -> dict:
    return {name: call for module in MODULES for name, call in module.QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
