"""Feed freshness and parse quality."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netfabric.functions.ids import DEFAULT_TENANT, text
from netfabric.functions.net import short_host
from netfabric.functions.timeargs import parse_time, ts_lit, window_filter
from netfabric.operators.upsert import collapse_superseded

TimeArg = str | datetime
STALENESS_HOURS = 2.0
OBSERVER_WINDOW = "now-7d"


def _hours_since(ts: Column, as_of: TimeArg) -> Column:
    seconds = F.unix_timestamp(ts_lit(parse_time(as_of))) - F.unix_timestamp(ts)
    return seconds / F.lit(3600.0)


def last_event_by_observer(
    events: DataFrame, as_of: TimeArg, *, since: TimeArg = OBSERVER_WINDOW, tenant: str | None = DEFAULT_TENANT,
) -> DataFrame:
    """Newest event per (logging device, provider) and the hours since."""
    df = events if tenant is None else events.filter(F.col("tenant_id") == tenant)
    df = df.filter(text("observer_hostname") != "").filter(window_filter("timestamp", since, None, as_of))
    newest = df.groupBy("observer_hostname", F.col("event_provider").alias("provider")).agg(
        F.max("timestamp").alias("last_event")
    )
    return newest.withColumn("hours_since", _hours_since(F.col("last_event"), as_of))


def ingest_status(
    nodes: DataFrame, events: DataFrame, as_of: TimeArg, *, staleness_hours: float = STALENESS_HOURS,
    since: TimeArg = OBSERVER_WINDOW, tenant: str | None = DEFAULT_TENANT,
) -> DataFrame:
    """One row per expected firewall; one that was never seen is stale.

    Expected are the topology's firewalls and every device that logged recently.
    """
    firewalls = collapse_superseded(
        nodes.filter((F.col("kind") == "device") & (F.col("attrs")["role"] == "firewall"))
    ).filter(text("name") != "").select("name", F.col("identifiers")["provider"].alias("_topo_provider"))
    seen = (
        last_event_by_observer(events, as_of, since=since, tenant=tenant)
        .groupBy(short_host("observer_hostname").alias("name"))
        .agg(F.max_by(F.struct("provider", "last_event", "hours_since"), F.struct("last_event", "provider")).alias("_seen"))
    )
    joined = firewalls.join(seen, "name", "full_outer")
    return joined.select(
        "name",
        F.coalesce(F.col("_seen.provider"), F.col("_topo_provider")).alias("provider"),
        F.col("_seen.last_event").alias("last_event"),
        F.col("_seen.hours_since").alias("hours_since"),
        F.coalesce(F.col("_seen.hours_since") > staleness_hours, F.lit(True)).alias("stale"),
    )


def ingest_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("stale").alias("stale"),
        F.count_if(~F.col("stale")).alias("fresh"),
    )


@dataclass(frozen=True)
class Subject:
    """One thing whose liveness is asserted, and the column that proves it.

    The column must be stamped when rows are written, never taken from the data.
    """

    name: str
    kind: str
    table: str
    ts_column: str
    budget_hours: float
    filter_column: str | None = None
    filter_value: str | None = None

    @property
    def signal(self) -> str:
        if self.filter_column is None:
            return f"{self.table}.{self.ts_column}"
        return f"{self.table}({self.filter_column}={self.filter_value})"


# Declared sources and resolvers with their freshness budgets.
MANIFEST = (
    Subject("juniper", "source", "events", "timestamp", 1.0, "event_provider", "juniper"),
    Subject("paloalto", "source", "events", "timestamp", 1.0, "event_provider", "paloalto"),
    Subject("proxmox", "source", "events", "timestamp", 24.0, "event_provider", "proxmox"),
    Subject("unifi", "source", "health_metrics", "timestamp", 0.5, "provider", "unifi"),
    Subject("topology", "resolver", "topo_observations", "observed_at", 0.25),
    Subject("entity", "resolver", "entity_edges", "last_seen", 0.25),
    Subject("policy", "resolver", "entities", "last_seen", 2.0, "source", "configured"),
    Subject("health", "resolver", "health_metrics", "timestamp", 0.25),
    Subject("public-metrics", "resolver", "metric_timeseries", "inserted_at", 0.25),
)

_PROBE_SCHEMA = "name string, n bigint, last_seen timestamp, error string"


def _probe(table: DataFrame, subjects: Sequence[Subject]) -> DataFrame:
    """Count and newest time of every subject of one table, in one scan."""
    aggs = []
    for i, s in enumerate(subjects):
        hit = F.lit(True) if s.filter_column is None else F.col(s.filter_column) == s.filter_value
        aggs.append(F.count_if(hit).alias(f"n{i}"))
        aggs.append(F.max(F.when(hit, F.col(s.ts_column).cast("timestamp"))).alias(f"t{i}"))
    row = table.agg(*aggs)
    items = F.array(*[
        F.struct(F.lit(s.name).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"t{i}").alias("last_seen"),
                 F.lit(None).cast("string").alias("error"))
        for i, s in enumerate(subjects)
    ])
    return row.select(F.inline(items))


def _error_rows(spark: SparkSession, subjects: Sequence[Subject], message: str) -> DataFrame:
    return spark.createDataFrame([(s.name, 0, None, message) for s in subjects], _PROBE_SCHEMA)


def fabric_status(
    spark: SparkSession, tables: dict[str, DataFrame], as_of: TimeArg, manifest: Sequence[Subject] = MANIFEST,
) -> DataFrame:
    """Freshness of each declared subject against its budget.

    A subject without rows is stale; a probe that cannot be planned (a missing
    table or column) is reported in ``error``, never left out.
    """
    by_table: dict[str, list[Subject]] = {}
    for s in manifest:
        by_table.setdefault(s.table, []).append(s)
    probes = []
    for name, subjects in by_table.items():
        if name not in tables:
            probes.append(_error_rows(spark, subjects, f"no such table: {name}"))
            continue
        try:
            probes.append(_probe(tables[name], subjects))
        except AnalysisException as exc:
            probes.append(_error_rows(spark, subjects, str(exc).splitlines()[0]))
    found = reduce(DataFrame.unionByName, probes)
    declared = spark.createDataFrame(
        [(s.name, s.kind, s.signal, float(s.budget_hours)) for s in manifest],
        "name string, kind string, signal string, budget_hours double",
    )
    hours = F.when(F.col("n") > 0, _hours_since(F.col("last_seen"), as_of))
    return declared.join(found, "name", "left").withColumn("hours_since", hours).select(
        "name", "kind", "signal", "budget_hours", "last_seen", "hours_since",
        F.coalesce(F.col("hours_since") > F.col("budget_hours"), F.lit(True)).alias("stale"), "error",
    )


def fabric_summary(status: DataFrame) -> DataFrame:
    s = status.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("stale").alias("stale"),
        F.count_if(~F.col("stale")).alias("fresh"), F.count_if(F.col("error").isNotNull()).alias("errored"),
    )
    return s.withColumn("healthy", (F.col("stale") == 0) & (F.col("errored") == 0))


def unparsed_rate(events: DataFrame) -> DataFrame:
    """Share of ``unknown`` and ``parse_error`` actions per provider and day."""
    bad = F.col("event_action").isin("unknown", "parse_error")
    return events.groupBy("event_provider", F.to_date("timestamp").alias("day")).agg(
        F.count_if(bad).alias("unparsed"), F.count(F.lit(1)).alias("total")
    ).withColumn("rate", F.col("unparsed") / F.col("total").cast("double"))
