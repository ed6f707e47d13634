"""All queries over the reference's own operators, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("lexical", "text", "affect", "entities", "graph", "sequence", "similarity", "evaluation", "store", "sources", "models", "streams", "reports")


def _all(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"telarium.plans.{name}"), kind, {})
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
