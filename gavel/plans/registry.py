"""The register of named queries: function, SQL for DuckDB where there is one, and the inventory rows it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name. `covers`: inventory rows, separated by blanks."""

    def register(run: Query) -> Query:
        if run.__name__ in ENTRIES:
            raise ValueError(f"two queries named {run.__name__}")
        ENTRIES[run.__name__] = Entry(run, sql, tuple(covers.split()))
        return run

    return register
