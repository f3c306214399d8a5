"""Every operator as a runnable query over the benchmark tables, with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


CATALOG: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    """Decorator that puts a query into the catalog."""
    def keep(fn: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Entry(fn, sql)
        return fn

    return keep


def load() -> dict[str, Entry]:
    """Import the query modules, which register themselves."""
    from hirecube.plans import queries_cube, queries_functions, queries_models, queries_reports, queries_sources  # noqa: F401

    return CATALOG
