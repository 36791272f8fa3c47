"""Named queries over the test tables, each with its DuckDB oracle text.

Every query reads whole tables through the adapter (``caravan.testdata``) and
runs the library's operator on them; nested outputs are rendered to flat
columns so the oracle can compare values. ``QUERIES[name] = (fn, sql)``; sql is
None where the result is not expressible in SQL (the driver then checks rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _load_all() -> None:
    # importing the query modules fills QUERIES
    from caravan.plans import queries_catalog  # noqa: F401
    from caravan.plans import queries_bookings  # noqa: F401
    from caravan.plans import queries_media  # noqa: F401
    from caravan.plans import queries_changes  # noqa: F401
    from caravan.plans import queries_functions  # noqa: F401
    from caravan.plans import queries_sources  # noqa: F401
    from caravan.plans import queries_streams  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in QUERIES.items() if v[1] is not None}
