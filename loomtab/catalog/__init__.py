"""Registered queries and the SQL each one must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("preparation", "evaluation", "neighbors", "closed_form", "trained", "streams")


def load_catalog():
    """(queries, oracle SQL) of every catalogue module, in order."""
    for name in MODULES:
        import_module(f"loomtab.catalog.{name}")
    from loomtab.catalog.common import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
