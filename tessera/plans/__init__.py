"""The library's queries over the driver's tables, each with SQL for its result."""

from __future__ import annotations

import importlib

from tessera.plans.registry import ORACLE, QUERIES, Query

#: Modules that register queries.
MODULES = ("retrieval", "graph", "recommend", "corpus", "ledger", "checks", "more", "rest", "evaluation", "profiles", "files")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
