"""A catalog of named queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derive import relation, sql


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, inputs: str, build: Callable[..., DataFrame], query: str | None = None, **ctes: str) -> None:
        """Register build(*relations) for the space-separated names in `inputs`."""
        names = inputs.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*[relation(spark, sf_dir, n) for n in names])

        self.queries[name] = run
        if query is not None:
            self.oracles[name] = sql(query, **ctes)
