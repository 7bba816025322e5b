"""Operators for training text. Nothing outside this package imports it."""

from __future__ import annotations

import importlib
from types import ModuleType

# Modules with QUERIES and SQL.
MODULES = ("record_queries", "text_queries", "document_queries")


def query_modules() -> list[ModuleType]:
    """The query modules of this package."""
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]
