"""Registered queries over the given tables, and the SQL each must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ["ranking", "preparation", "lexical", "matching", "documents", "applications", "stored"]


def _merged(attribute: str) -> dict:
    merged = {}
    for name in MODULES:
        merged |= getattr(import_module(f"pairloom.catalog.{name}"), attribute)
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
