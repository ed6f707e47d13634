"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ledger", "consensus", "cooccur", "nearsets", "tokenizer", "residue", "mixture", "names", "linkage", "ocrtext")


def _all(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"telarium.llm.{name}"), kind, {})
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
