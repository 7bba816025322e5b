"""Helpers for the DuckDB side."""

from __future__ import annotations

import re

_TRIM = re.compile(r"\btrim\(([^(),]+)\)", re.I)


def blank_trim(sql: str) -> str:
    """``trim(x)`` takes only blanks off in Spark, any white space in DuckDB: state the blank."""
    return _TRIM.sub(r"trim(\1, ' ')", sql)


def all_blank_trim(sql: dict[str, str]) -> dict[str, str]:
    return {name: blank_trim(text) for name, text in sql.items()}
