"""Registry of named queries: ``name -> (spark builder, oracle SQL)``.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole of the given tables.  ``__spark_entry__`` exposes the registry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.plans.views import Tables

Builder = Callable[[Tables], DataFrame]

REGISTRY: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def _load():
    # importing the modules fills the registry
    from parley.plans import queries_dashboard  # noqa: F401
    from parley.plans import queries_messages  # noqa: F401
    from parley.plans import queries_misc  # noqa: F401
    from parley.plans import queries_streaming  # noqa: F401
    from parley.plans import queries_stored  # noqa: F401
    from parley.plans import sql_pipeline  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda fn: (lambda spark, sf_dir: fn(Tables(spark, sf_dir))))(fn) for name, fn in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
