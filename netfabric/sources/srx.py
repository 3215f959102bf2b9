"""Security logs with structured data: sessions, screen alerts and other security records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.functions.net import ipv4_or_null
from netfabric.sources.syslog import (
    event_rows, keep_if, known_device, no_entries, parse_syslog_header, port, structured_data_map,
)

# Message ids of sessions and the transport numbers.
SESSIONS = {
    "rt_flow_session_create": ("flow_session_create", "success"),
    "rt_flow_session_close": ("flow_session_close", "success"),
    "rt_flow_session_deny": ("flow_session_deny", "failure"),
}
TRANSPORTS = {6: "tcp", 17: "udp", 1: "icmp"}


def security_route(parsed: DataFrame) -> Column:
    """Lines of the security stream; what cannot be parsed is kept, to be counted."""
    rt = F.coalesce(F.col("appname").startswith("RT_"), F.lit(False)) | F.coalesce(F.col("msgid").startswith("RT_"), F.lit(False))
    return ~F.col("parsed") | rt


def transport_name(protocol: Column) -> Column:
    number = protocol.try_cast("int")
    chain = F.lit("unknown")
    for value, name in TRANSPORTS.items():
        chain = F.when(number == value, name).otherwise(chain)
    return chain


def _number(fields: Column, key: str, kind: str = "long") -> Column:
    """A counter; a missing one is 0, one that is no number is NULL."""
    value = fields[key]
    return F.when(value.isNull(), F.lit(0).cast(kind)).otherwise(value.try_cast(kind))


def normalise_srx(raw: DataFrame, devices: tuple[str, ...] | None = None) -> DataFrame:
    """Raw lines of the shared security port to events (a pure projection)."""
    df = parse_syslog_header(raw)
    df = keep_if(df, security_route(df)).withColumns({
        "f": F.when(F.col("parsed"), structured_data_map(F.coalesce("structured_data", "message"))).otherwise(no_entries()),
        "code": F.lower(F.coalesce("msgid", F.lit(""))),
    })
    f, code, parsed = F.col("f"), F.col("code"), F.col("parsed")
    attack = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(f["attack-name"], F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    screen = code.startswith("rt_screen")

    action, outcome = F.when(~parsed, "parse_error"), F.when(~parsed, "unknown")
    for msgid, (name, result) in SESSIONS.items():
        action, outcome = action.when(code == msgid, name), outcome.when(code == msgid, result)
    action = (
        action.when(screen, F.when(attack != "", F.concat(F.lit("screen_"), attack)).otherwise("screen"))
        .when(code.startswith("rt_"), code).otherwise("unknown")
    )
    outcome = outcome.when(screen, "failure").otherwise("unknown")

    sent, received = _number(f, "bytes-from-client"), _number(f, "bytes-from-server")
    known = lambda value: F.when(parsed, value)
    return event_rows(
        df, "srx", "juniper",
        event_provider=F.when(parsed, "juniper").otherwise(""),
        timestamp=F.coalesce("header_ts", "received_at"), event_action=action, event_outcome=outcome,
        event_kind=F.when(parsed & screen, "alert").otherwise("event"),
        event_category=known(F.when(screen, F.array(F.lit("network"), F.lit("intrusion_detection"))).otherwise(F.array(F.lit("network")))),
        source_ip=ipv4_or_null(f["source-address"]), destination_ip=ipv4_or_null(f["destination-address"]),
        source_port=known(port(_number(f, "source-port"))), destination_port=known(port(_number(f, "destination-port"))),
        source_bytes=known(sent), destination_bytes=known(received), network_bytes=known(sent + received),
        network_transport=known(transport_name(f["protocol-id"])), rule_name=f["policy-name"],
        observer_ingress_zone=f["source-zone-name"], observer_egress_zone=f["destination-zone-name"],
        observer_hostname=known_device(F.col("hostname"), devices),
        user_name=F.when(f["username"] != "N/A", f["username"]), ext=f,
    )
