"""Registry of named queries: each pairs a Spark plan with, where it exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpuslane.session import Tables


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``covers`` lists the survey ids it serves."""

    def add(fn):
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, tuple(covers.split()), fn, sql)
        return fn

    return add


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.run(Tables(spark, sf_dir))

    run.__name__ = entry.name
    return run
