"""All queries of the library by name, each with its DuckDB SQL."""

from __future__ import annotations

import importlib

from docloom.plans.registry import ORACLES, QUERIES, Query

MODULES = ("relational", "retrieval", "textsearch", "scoring", "feedback", "relations", "streams", "tables", "multidoc", "upkeep", "stores", "layout")
for _name in MODULES:
    importlib.import_module(f"docloom.plans.{_name}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
