"""The operators bound to the star-schema tables, each with its oracle SQL.

    flight    = orders (F Completed, O Scheduled, P Full)
    seat line = lineitem rows (N kept, R cancelled by customer, A by system)
    plane     = part brand / supplier, route = customer nation -> supplier nation
    requests, holds, payments, sessions, busy spans = events
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its oracle."""
    def register(build: Callable[[SparkSession, str], DataFrame]):
        from tarmaq.bindings.views import portable
        from tarmaq.session import tune

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(build(tune(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build
    return register


def load() -> None:
    from tarmaq.bindings import checks, listings, reports, states, store, streams  # noqa: F401
