"""All queries of the library and the SQL they are checked against."""

from __future__ import annotations

import importlib

MODULES = ("relational", "texts", "graphs", "code")


def _merged(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"{__package__}.plans.{m}"), what).items()}


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
