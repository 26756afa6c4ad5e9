"""All runnable queries by name, and the SQL each is checked against."""

from __future__ import annotations

import importlib

from daftar.catalog.base import QUERIES, SQL, Query

MODULES = ["tables", "joins", "aggregates", "windows", "functions", "corpus", "streams"]


def load() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"daftar.catalog.{name}")
    return dict(QUERIES)


__all__ = ["load", "QUERIES", "SQL"]
