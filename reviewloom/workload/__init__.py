"""The registered queries."""

from __future__ import annotations

from importlib import import_module

from reviewloom.workload.base import ORACLES, QUERIES

MODULES = ("text", "prepare", "features", "scoring", "mining", "models")


def _load() -> None:
    for name in MODULES:
        import_module(f"reviewloom.workload.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
