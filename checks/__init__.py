"""Queries over the test tables, with the SQL each one is compared to."""

from __future__ import annotations


def all_checks() -> tuple[dict, dict]:
    """(queries, oracles) of all check modules."""
    from importlib import import_module

    for module in ("records", "evaluation", "audits", "study", "probes", "claims"):
        import_module(f"checks.{module}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
