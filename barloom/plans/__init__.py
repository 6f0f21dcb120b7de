"""Registered queries over the given tables, one per operator, with their SQL counterparts."""

import importlib

MODULES = ("sources", "alignment", "aggregates", "windows", "text", "signals", "backtests", "regimes", "decisions", "derivatives", "changes")


def all_queries():
    """(queries, sql) of every plan module."""
    from barloom.plans import registry

    for name in MODULES:
        importlib.import_module(f"barloom.plans.{name}")
    return registry.QUERIES, registry.ORACLE
