"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_MAP = T.MapType(T.StringType(), T.StringType())
_STR, _TS, _LONG, _INT, _DBL = T.StringType(), T.TimestampType(), T.LongType(), T.IntegerType(), T.DoubleType()
_STRS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_LOGS = _struct(received_at=_TS, feed=_STR, message=_STR)

EVENTS = _struct(
    timestamp=_TS, event_id=_STR, tenant_id=_STR, event_kind=_STR, event_category=_STRS, event_action=_STR,
    event_outcome=_STR, event_provider=_STR, source_ip=_STR, source_port=_INT, source_bytes=_LONG,
    destination_ip=_STR, destination_port=_INT, destination_bytes=_LONG, network_transport=_STR,
    network_bytes=_LONG, rule_name=_STR, observer_ingress_zone=_STR, observer_egress_zone=_STR,
    observer_hostname=_STR, user_name=_STR, ext=_MAP, raw=_STR,
)

OBSERVATIONS = _struct(
    observed_at=_TS, collector=_STR, source_device=_STR, tenant_id=_STR, layer=_STR, observation_type=_STR,
    subj_kind=_STR, subj_id=_STR, obj_kind=_STR, obj_id=_STR, attrs=_MAP, raw=_STR,
)

GAUGES = _struct(
    timestamp=_TS, tenant_id=_STR, provider=_STR, device=_STR, scope=_STR, metric_class=_STR, sensor=_STR,
    metric_name=_STR, metric_value=_DBL, unit=_STR, raw=_STR,
)

SNAPSHOTS = _struct(
    provider=_STR, device=_STR, command=_STR, collected_at=_TS, truncated=T.BooleanType(), body=_STR,
)

AUDIT = _struct(
    ts=_TS, principal=_STR, tier=_STR, tool=_STR, args=_STR, data_classes=_STRS, decision=_STR, row_count=_LONG,
    error=_STR, client_name=_STR, model_id=_STR, actor_type=_STR, prev_hash=_STR, row_hash=_STR,
)

EVIDENCE_ARGS = _struct(
    request_id=_STR, changeset_id=_STR, device_id=_STR, diff_hash=_STR, run_id=_STR, server_id=_STR,
    segment_seq=_LONG, prev_hash=_STR, approver=_STR, metadata=_MAP,
)

RULE_USAGE = _struct(
    tenant_id=_STR, bucket_start=_TS, provider=_STR, observer_hostname=_STR, rule_name=_STR, sessions=_LONG,
    bytes=_LONG, inserted_at=_TS,
)

METRIC_SERIES = _struct(bucket_start=_TS, metric=_STR, dim=_STR, value=_DBL, tenant_id=_STR, inserted_at=_TS)
ENTITY_SERIES = _struct(bucket_start=_TS, surrogate=_STR, metric=_STR, value=_DBL, tenant_id=_STR, inserted_at=_TS)
PSEUDONYMS = _struct(
    kind=_STR, real_value=_STR, surrogate=_STR, key_version=_INT, first_seen=_TS, last_seen=_TS,
)
