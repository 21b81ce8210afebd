"""Queries on the driver tables and the SQL that checks them."""

from importlib import import_module

MODULES = ["listing", "reports", "planning", "search", "vectors", "linkage", "graph", "text", "checks", "edits", "streams"]


def load():
    """All registered queries and oracles."""
    for m in MODULES:
        import_module(f"quire.catalog.{m}")
    from quire.catalog import registry

    return dict(registry.QUERIES), dict(registry.ORACLES)
