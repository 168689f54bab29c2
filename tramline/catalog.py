"""Every registered query with its DuckDB equivalent."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from .adapters import Tables, with_views

FLAGSHIP = "a3_stop_headways"
MODULES = ("service", "spatial", "questions", "journeys", "network", "scoring", "feeds", "layers", "scalars", "storage", "shapes")
_FOUND: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ()) -> Callable:
    """Registers a function of the tables under ``name``; ``sql`` is its DuckDB text over ``views``."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _FOUND:
            raise ValueError(f"{name} is taken")
        _FOUND[name] = (f, None if sql is None else with_views(views, sql))
        return f

    return keep


@cache
def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _FOUND.items() if sql is not None}
