"""Session settings and lineage control."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on for right results.  All are runtime settings,
# so they can be applied to a session somebody else built.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Settings that only affect speed.  They are used when we build the session.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need to an existing session."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "netfabric", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the package defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**TUNING_CONF, **REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="netfabric-ckpt-"))
        return sc._jsc.sc().getCheckpointDir().get()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; iterative operators need a folder all executors share"
    )


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path, for files that all executors share, beside the checkpoints."""
    return f"{_checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back without its history.

    The files survive the loss of any executor.  A written table also has a
    known size, which a plain checkpoint has not (it keeps the estimate of the
    plan it replaced), so joins against it can tell whether it may be broadcast.
    With ``partition_by``, later filters on those columns read only their folders.
    """
    path = shared_path(df.sparkSession, "netfabric")
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
