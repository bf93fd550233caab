"""All registered queries."""

from __future__ import annotations

import importlib

from hearthline.registered.base import ORACLE, QUERIES, Query

MODULES = ("source_queries", "cleaning_queries", "aggregate_queries", "ordering_queries", "text_queries", "paired_queries", "log_queries", "model_queries", "mean_queries")


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"hearthline.registered.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
