"""Every registered query, with the SQL that checks it where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("text_profile", "text_cleaning", "searching", "readings", "numeric", "page_plans", "layout", "flow", "assets", "events", "composed")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"quire.catalog.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict[str, Callable]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
