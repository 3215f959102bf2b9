"""Intrusion detections in Common Event Format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.functions.net import ipv4_or_null
from netfabric.sources.syslog import event_rows, ext_map, port

# The gate and the extension fields that are kept, in order.
VENDOR_MARK, THREAT_MARK = "CEF:0|Ubiquiti", "|Threat Detected|"
EXT_FIELDS = {
    "unifi.ips.signature": "UNIFIipsSignature", "unifi.ips.signature_id": "UNIFIipsSignatureId",
    "unifi.ips.category": "UNIFIcategory", "unifi.ips.risk": "UNIFIrisk", "unifi.ips.app_proto": "app",
    "unifi.ips.policy_type": "UNIFIpolicyType", "unifi.direction": "UNIFIdirection", "unifi.src_mac": "UNIFIsrcClientMac",
    "unifi.dst_mac": "UNIFIdstClientMac", "unifi.src_alias": "UNIFIsrcClientAlias", "unifi.dst_alias": "UNIFIdstClientAlias",
    "unifi.device_name": "UNIFIdeviceName", "unifi.device_ip": "UNIFIdeviceIp", "unifi.session_id": "UNIFIipsSessionId",
    "unifi.src_zone": "UNIFIsrcZone", "unifi.dst_zone": "UNIFIdstZone", "unifi.dst_region": "UNIFIdstRegion",
}
# Seven header fields split by unescaped bars, then the extension.
_PART = r"([^|\\]*+(?:\\.[^|\\]*+)*+)\|"
_HEADER = rf"(?s)^.*?CEF:(\d++)\|{_PART * 6}(.*)\z"
_FS, _MARK = "\x1f", "\x1eC"
HEADER_FIELDS = ("version", "vendor", "product", "device_version", "signature_id", "name", "severity")


def unifi_gate() -> Column:
    """Detections only; the port also carries the gateway's own system logs."""
    return F.col("message").contains(VENDOR_MARK) & F.col("message").contains(THREAT_MARK)


def parse_cef(df: DataFrame, message: str = "message") -> DataFrame:
    """Adds ``cef_ok``, the seven header fields as ``cef_<name>`` and the extension map ``cef``.

    Values keep inner spaces; a value ends before the next ``word=``.
    """
    line = F.rtrim(message, F.lit(" \r\n\t"))
    spread = _MARK + "".join(f"{_FS}${i}" for i in range(1, 9))
    df = df.withColumn("_c", F.split(F.regexp_replace(line, _HEADER, spread), _FS, 9))
    df = df.withColumn("cef_ok", F.col("_c")[0] == _MARK)
    part = lambda i: F.when(F.col("cef_ok"), F.try_element_at("_c", F.lit(i + 1)))
    pairs = F.filter(F.split(F.trim(F.coalesce(part(8), F.lit(""))), r"\s+(?=\w+=)"), lambda p: p.rlike(r"^\w+="))
    value = lambda p: F.substring(p, F.locate("=", p) + 1, F.length(p))
    plain = lambda v: F.when(v.contains("\\"), F.regexp_replace(v, r"\\([\\=|])", "$1")).otherwise(v)
    entries = F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), plain(value(p)).alias("value")))
    columns = {"cef": F.map_from_entries(entries)}
    columns.update({f"cef_{name}": part(i) for i, name in enumerate(HEADER_FIELDS, start=1)})
    return df.withColumns(columns).drop("_c")


def normalise_unifi(raw: DataFrame) -> DataFrame:
    """Detection lines to events; endpoints are often known by MAC and alias only."""
    df = parse_cef(raw.filter(unifi_gate()))
    doc, ok = F.col("cef"), F.col("cef_ok")
    get = lambda key: F.coalesce(doc[key], F.lit(""))
    policy, act = get("UNIFIpolicyName"), F.lower(get("act"))
    action = F.when(~ok, "parse_error").when(
        policy != "", F.concat(F.lit("alert_"), F.replace(F.lower(policy), F.lit(" "), F.lit("-")))
    ).otherwise("alert")
    addr = lambda key: F.when(ipv4_or_null(get(key)).isNull(), get(key))
    # A header severity stands in the extension map's place only when that has none.
    severity = F.coalesce(doc["severity"], F.col("cef_severity"))
    pairs = [
        ("unifi.dst_addr", addr("dst")), ("unifi.src_addr", addr("src")), ("unifi.ips.severity", F.when(ok, severity)),
        ("unifi.ips.action", act), *[(name, doc[key]) for name, key in EXT_FIELDS.items()],
    ]
    return event_rows(
        df, "unifi", "unifi",
        timestamp=F.coalesce(F.try_to_timestamp(doc["UNIFIutcTime"]), "received_at"), event_action=action,
        event_kind=F.when(ok, "alert").otherwise("event"),
        event_category=F.when(ok, F.array(F.lit("intrusion_detection"))).otherwise(F.array(F.lit("network"))),
        event_outcome=F.when(~ok, "unknown").when(act.isin("blocked", "dropped"), "failure").otherwise("detection"),
        network_transport=F.coalesce(F.nullif(F.lower(get("proto")), F.lit("")), F.lit("unknown")),
        source_port=port(doc["spt"]), destination_port=port(doc["dpt"]),
        source_ip=ipv4_or_null(get("src")), destination_ip=ipv4_or_null(get("dst")),
        source_bytes=doc["UNIFIbytesSent"].try_cast("long"), destination_bytes=doc["UNIFIbytesReceived"].try_cast("long"),
        network_bytes=doc["UNIFItotalBytes"].try_cast("long"), observer_hostname=get("UNIFIdeviceName"), ext=ext_map(*pairs),
    )
