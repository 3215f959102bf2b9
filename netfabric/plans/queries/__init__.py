"""Registered queries over the driver's tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netfabric.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries and their check SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return naive(fn(prepare(spark), sf_dir))

            self.queries[name] = run
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return register


def naive(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the check engine returns them."""
    zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: df[c].cast("timestamp_ntz") for c in zoned}) if zoned else df


REGISTRY = Registry()


def load_all() -> Registry:
    """Import every query module once and return the registry."""
    from netfabric.plans.queries import (  # noqa: F401
        access, audit, entities, flows, ingest, metrics, policy, scoring, snapshots, topology, upserts,
    )
    return REGISTRY
