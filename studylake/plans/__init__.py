"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

#: Modules of queries; each has QUERIES and ORACLE_SQL.
MODULES = ("progress", "planning", "quality", "questions", "streaming", "files")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f".{module}", __name__), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE_SQL")
