"""Registry of the queries over the test tables."""
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def register(covers: str, sql: str | None = None, ints: str = ""):
    """Register a query under its function name with the inventory items it covers.  ``ints`` are columns the SQL twin
    counts as BIGINT and Spark as INT."""
    if sql and ints:
        sql = "SELECT * REPLACE (" + ", ".join(f"{c}::INT AS {c}" for c in ints.split()) + f") FROM ({sql})"

    def add(run):
        key = run.__name__
        if key in ENTRIES:
            raise ValueError(f"query {key} is registered twice")
        ENTRIES[key] = Entry(run, sql, tuple(covers.split()))
        return run
    return add
