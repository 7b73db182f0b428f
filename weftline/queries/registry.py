"""Where query modules register their Spark function and, where SQL can express it, the oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.adapters import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a function under ``name``. With ``views`` it gets those adapter views, else (spark, sf_dir).
    ``sql`` is its DuckDB oracle, which may name the views."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = (lambda spark, sf_dir: fn(*(view(spark, sf_dir, v) for v in views))) if views else fn
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return put


for _module in ("journal", "sources", "relational", "graph", "scoring", "traffic", "html", "streams"):
    importlib.import_module(f"weftline.queries.{_module}")
