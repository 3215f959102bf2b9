"""Writers of the event, observation, gauge and version tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfabric.operators.upsert import append_rows


def with_event_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("timestamp"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Events by day, sorted inside files so that row-group statistics skip.

    The rebalance lets the runtime split a busy day over several tasks and join
    quiet ones, instead of one task and file per day.
    """
    dated = with_event_date(events).hint("rebalance", "event_date")
    dated.sortWithinPartitions("event_date", "tenant_id", "timestamp").write.mode(mode).partitionBy("event_date").parquet(path)


def write_observations(rows: DataFrame, path: str) -> None:
    append_rows(rows.withColumn("observed_date", F.to_date("observed_at")), path, ["observed_date"])


def write_gauges(rows: DataFrame, path: str) -> None:
    append_rows(rows.withColumn("gauge_date", F.to_date("timestamp")), path, ["gauge_date"])


def write_versions(rows: DataFrame, path: str) -> None:
    append_rows(rows, path)
