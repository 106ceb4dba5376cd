"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and SQL, in the order of their operators.
MODULES = ("toxicity", "line_dedup", "quality", "langid", "sharding", "simhash", "pieces", "mixing", "exact_dedup", "urls")


def _merged(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"{__package__}.{m}"), what).items()}


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
