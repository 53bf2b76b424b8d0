"""Registered queries over the driver tables: operator id -> (Spark plan, oracle SQL)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("diffs", "texts", "catalog", "search", "answers", "monitoring", "evaluation", "parsing", "extras")


def registry() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"clausewise.plans.{name}").QUERIES
    return out
