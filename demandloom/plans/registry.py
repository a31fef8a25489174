"""Every job that runs over the star tables, with its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demandloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("landing", "totals", "forecast", "choose", "models", "records", "split", "compare")

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def job(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``oracle`` is the SQL twin."""

    def wrap(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _queries[name] = run
        if oracle is not None:
            _oracles[name] = oracle
        return fn

    return wrap


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"demandloom.plans.{module}")
    return dict(_queries), dict(_oracles)
