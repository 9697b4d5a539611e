"""Registry of named queries: Spark implementation + DuckDB oracle text.

Each query reads the driver tables of one scale-factor folder (through the
canonical tables of ``sources/tables.py``) and returns a DataFrame whose
column names equal the oracle's. Computed doubles that depend on summation
order are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.plans.oracle_views import oracle
from larder.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_BODIES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` (with oracle SQL body)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__name__ = f"query_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            _BODIES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from larder.plans import queries_forecast  # noqa: F401
    from larder.plans import queries_data  # noqa: F401
    from larder.plans import queries_quality  # noqa: F401
    from larder.plans import queries_ml  # noqa: F401
    from larder.plans import queries_catalog  # noqa: F401
    from larder.plans import queries_scoring  # noqa: F401
    from larder.plans import queries_models  # noqa: F401
    from larder.plans import queries_io  # noqa: F401
    for name, body in _BODIES.items():  # views are known only when all modules are
        if name not in ORACLES:
            ORACLES[name] = oracle(body)
