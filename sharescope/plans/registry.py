"""Registered queries: a Spark callable per name and, where SQL can say it, the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from ..sources.derived import Estate
from .base_sql import with_tables

QueryFn = Callable[[Estate], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    covers: str
    build: QueryFn
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return self.build(Estate(spark, folder))


REGISTRY: dict[str, Registered] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register a query. `covers` lists the operator numbers it exercises; `sql` may use the derived tables."""
    def add(build: QueryFn) -> QueryFn:
        key = name or build.__name__
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        REGISTRY[key] = Registered(key, covers, build, with_tables(sql) if sql else None)
        return build

    return add


def load() -> dict[str, Registered]:
    from . import (catalogue_queries, folderplan_queries, people_queries, permission_queries,  # noqa: F401
                   report_queries, scan_queries, search_queries, text_queries, tree_queries)

    return REGISTRY
