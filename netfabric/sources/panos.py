"""Firewall logs in positional CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.functions.net import ipv4_or_null
from netfabric.sources.syslog import event_rows, ext_map, known_device, parse_syslog_header, port

# Positions of the fields (from 0) and the actions that deny.
COMMON = {
    "type": 3, "subtype": 4, "generated": 6, "src": 7, "dst": 8, "nat_src": 9, "nat_dst": 10, "rule": 11, "user": 12, "app": 14,
    "src_zone": 16, "dst_zone": 17, "session": 22, "src_port": 24, "dst_port": 25, "protocol": 29, "action": 30,
}
TRAFFIC = {"bytes": 31, "sent": 32, "received": 33, "end_reason": 46}
THREAT = {"threat_id": 32, "category": 33, "severity": 34, "direction": 35}
SYSTEM = {"event_id_str": 8, "module": 12, "severity": 13}
CONFIG = {"command": 9, "admin": 10, "client": 11, "result": 12}
DENY_ACTIONS = ("deny", "drop", "reset-both", "reset-client", "reset-server")
GENERATED_FORMAT = "yyyy/MM/dd HH:mm:ss"


def _at(index: int) -> Column:
    return F.coalesce(F.try_element_at(F.col("f"), F.lit(index + 1)), F.lit(""))


def _panw(name: str) -> str:
    return f"panw.panos.{name}"


def normalise_panos(raw: DataFrame, devices: tuple[str, ...] | None = None) -> DataFrame:
    """Raw CSV lines to events.  The split is plain; quoted commas are not honoured."""
    df = parse_syslog_header(raw)
    # The payload starts at the first comma: its first field is empty.
    line = F.rtrim("message", F.lit(" \r\n"))
    df = df.withColumn("f", F.split(F.substring(line, F.greatest(F.locate(",", line), F.lit(1)), F.length(line)), ","))
    df = df.withColumns({f"c_{name}": _at(i) for name, i in COMMON.items()})
    c = {name: F.col(f"c_{name}") for name in COMMON}
    kind, subtype = F.upper(c["type"]), F.lower(c["subtype"])
    action = F.lower(c["action"])
    flow = kind.isin("TRAFFIC", "THREAT")
    traffic, threat, system, config = kind == "TRAFFIC", kind == "THREAT", kind == "SYSTEM", kind == "CONFIG"
    other = ~flow & ~system & ~config & (kind != "")

    name = (
        F.when(traffic, F.concat(F.lit("flow_"), subtype)).when(threat, F.concat(F.lit("threat_"), subtype))
        .when(system, F.concat(F.lit("system_"), subtype)).when(config, F.concat(F.lit("config_"), subtype))
        .when(other & (subtype != ""), F.concat(F.lower(kind), F.lit("_"), subtype)).when(other, F.lower(kind))
    )
    categories = (
        F.when(threat, F.array(F.lit("network"), F.lit("intrusion_detection"))).when(system, F.array(F.lit("host")))
        .when(config, F.array(F.lit("configuration"))).otherwise(F.array(F.lit("network")))
    )
    outcome = F.when(flow, F.when(action == "allow", "success").when(action.isin(*DENY_ACTIONS), "failure").otherwise("unknown"))
    transport = F.when(flow, F.coalesce(F.nullif(F.lower(c["protocol"]), F.lit("")), F.lit("unknown")))
    admin = _at(CONFIG["admin"])
    user = F.when(flow & (c["user"] != "N/A"), c["user"]).when(config & (admin != "N/A"), admin)
    real = lambda ip: F.when(ip != "0.0.0.0", ip)

    pairs = [
        (_panw("subtype"), c["subtype"]), (_panw("application"), c["app"]), (_panw("session_id"), c["session"]),
        (_panw("nat_source_ip"), real(c["nat_src"])), (_panw("nat_destination_ip"), real(c["nat_dst"])),
        (_panw("session_end_reason"), F.when(traffic, _at(TRAFFIC["end_reason"]))),
        *[(_panw(n), F.when(threat, _at(THREAT[n]))) for n in ("threat_id", "category", "direction")],
        (_panw("severity"), F.when(threat, _at(THREAT["severity"])).when(system, _at(SYSTEM["severity"]))),
        *[(_panw(n), F.when(system, _at(SYSTEM[n]))) for n in ("event_id_str", "module")],
        *[(_panw(n), F.when(config, _at(CONFIG[n]))) for n in ("command", "client", "result")],
        (_panw("type"), F.when(other, kind)),
    ]
    return event_rows(
        df, "panos", "paloalto",
        timestamp=F.coalesce(F.try_to_timestamp(c["generated"], F.lit(GENERATED_FORMAT)), "header_ts", "received_at"),
        event_category=categories, event_action=name, event_outcome=outcome, network_transport=transport,
        source_ip=F.when(flow, ipv4_or_null(c["src"])), destination_ip=F.when(flow, ipv4_or_null(c["dst"])),
        source_port=F.when(flow, port(c["src_port"])), destination_port=F.when(flow, port(c["dst_port"])),
        **{
            column: F.when(traffic, _at(TRAFFIC[field]).try_cast("long"))
            for column, field in (("network_bytes", "bytes"), ("source_bytes", "sent"), ("destination_bytes", "received"))
        },
        rule_name=F.when(flow, c["rule"]), observer_ingress_zone=F.when(flow, c["src_zone"]),
        observer_egress_zone=F.when(flow, c["dst_zone"]), observer_hostname=known_device(F.col("hostname"), devices),
        user_name=user, ext=ext_map(*pairs),
    )
