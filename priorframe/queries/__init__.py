"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("windows", "positions", "aggregates", "scalars", "models", "builders", "lineups", "screens", "candidates", "forming", "boards", "screening", "streams")


def load() -> tuple[dict, dict]:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    from priorframe.queries import base

    return base.QUERIES, base.SQL
