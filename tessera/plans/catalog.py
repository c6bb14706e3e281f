"""All queries of the library, by name."""

from __future__ import annotations

import importlib

from tessera.plans.registry import CALLS, SQL, Query

MODULES = ("events", "changelog", "search", "graphs", "files", "transcripts", "code", "views", "streams", "retrieval", "analysis", "sessions", "structure")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(CALLS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
