"""Queries over the given tables, grouped by family."""

from __future__ import annotations

import importlib

FAMILIES = [
    "panel",
    "cohort",
    "ledger",
    "compare",
    "indexes",
    "vintages",
    "timeseries",
    "feeds",
    "metro",
    "sources",
    "text",
]


def load_all():
    """Import every family once and return (queries, DuckDB texts)."""
    from statloom.plans import registry

    for family in FAMILIES:
        importlib.import_module(f"statloom.plans.{family}")
    return registry.QUERIES, registry.ORACLES
