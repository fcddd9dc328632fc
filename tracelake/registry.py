"""Queries by name, and their equivalents in SQL."""

from __future__ import annotations

from .plans import dialect, metadata, relational, rules, sketches, texts, views

MODULES = (views, relational, texts, rules, metadata, sketches, dialect)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: sql for m in MODULES for k, sql in m.ORACLES.items()}
