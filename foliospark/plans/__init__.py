"""Registered queries, grouped by subject."""

from __future__ import annotations

import importlib

from foliospark.plans.registry import ORACLES, QUERIES

MODULES = ("corpus", "search", "operations", "assistant", "tables", "quality", "structured", "runs", "logs", "marked")


def load_all():
    """Import every plan module and return (queries, oracle SQL)."""
    for name in MODULES:
        importlib.import_module(f"foliospark.plans.{name}")
    return QUERIES, ORACLES
