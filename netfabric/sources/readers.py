"""Batch and streaming readers of raw lines and evidence records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netfabric import schemas

# The five feeds.
FEEDS = ("srx", "panos", "unifi", "proxmox", "junos_sys")


def read_raw_logs(spark: SparkSession, path: str, *, streaming: bool = False, fmt: str = "text") -> DataFrame:
    """Landed lines as ``(received_at, feed, message)``.

    Text files lie in ``feed=<name>/`` folders; their modification time stands
    for the time of receipt.  Parquet and JSON carry the three columns.  The
    feed is a partition column, so a reader of one feed reads only its files.
    """
    reader = spark.readStream if streaming else spark.read
    if fmt == "text":
        lines = reader.format("text").schema("value string, feed string").load(path)
        return lines.select(
            F.col("_metadata.file_modification_time").alias("received_at"), "feed", F.col("value").alias("message")
        )
    return reader.format(fmt).schema(schemas.RAW_LOGS).load(path)


def read_raw_logs_kafka(spark: SparkSession, options: dict[str, str], topics: dict[str, str], *, streaming: bool = True) -> DataFrame:
    """Lines from Kafka; ``topics`` maps a topic name to its feed."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.format("kafka").options(**options).option("subscribe", ",".join(topics)).load()
    feed = F.create_map(*[F.lit(x) for pair in topics.items() for x in pair])[F.col("topic")]
    return rows.select(F.col("timestamp").alias("received_at"), feed.alias("feed"), F.col("value").cast("string").alias("message"))


def read_evidence(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """Newline-delimited JSON change records with ids and sequence pulled from the payload.

    Lines that are not records keep their text in ``_corrupt_record``.
    """
    schema = T.StructType([*schemas.AUDIT.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSS]"
    ).json(path)
    return parse_evidence(rows)


def parse_evidence(rows: DataFrame) -> DataFrame:
    """Adds ``server_id``, ``run_id``, ``segment_seq`` and the other payload fields."""
    payload = F.from_json("args", schemas.EVIDENCE_ARGS)
    parsed = rows.withColumn("_p", payload)
    names = ("server_id", "run_id", "segment_seq", "request_id", "changeset_id", "device_id", "diff_hash", "approver")
    return parsed.withColumns({n: F.col(f"_p.{n}") for n in names}).drop("_p")
