"""Registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "timelines",
    "sampling",
    "forecasts",
    "studies",
    "gates",
    "statistics",
    "decisions",
    "checks",
    "streams",
)


def load() -> tuple[dict, dict]:
    """All registered queries and, by the same names, the SQL of those that have one."""
    from longspark.catalog.registry import ORACLES, QUERIES

    for name in MODULES:
        import_module(f"longspark.catalog.{name}")
    return QUERIES, ORACLES
