"""All registered queries and their DuckDB twins, gathered from the plan modules."""

from __future__ import annotations

import importlib

_MODULES = [
    "duplicates",
    "diffs",
    "intake",
    "architecture",
    "reviews",
    "events",
    "segments",
    "streams",
]


def _mods():
    return [importlib.import_module(f"changelens.plans.{m}") for m in _MODULES]


def _shipped(fn):
    def run(spark, sf_dir):
        from ..session import ship_package
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict:
    out = {}
    for m in _mods():
        for k, v in m.QUERIES.items():
            if k in out:
                raise KeyError(f"duplicate query name {k}")
            out[k] = _shipped(v)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _mods():
        out.update(getattr(m, "ORACLE", {}))
    return out
