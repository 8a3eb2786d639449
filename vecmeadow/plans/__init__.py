"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("vectors", "series", "discovery", "records", "scalars", "streams", "clips")


def _load():
    from vecmeadow.plans import registry

    for module in MODULES:
        import_module(f"vecmeadow.plans.{module}")
    return registry


def queries():
    return dict(_load().QUERIES)


def oracles():
    return dict(_load().ORACLES)
