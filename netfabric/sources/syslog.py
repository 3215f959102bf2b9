"""Syslog headers, structured data and the columns every normalised event has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric import schemas
from netfabric.functions.ids import DEFAULT_TENANT, event_id

# RFC 5424: <pri>version time host app procid msgid structured-data message.
# Possessive repeats: no backtracking and no deep recursion on long lines.
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SD = rf'(?:-|(?:\[[^\]"]*+(?:{_QUOTED}[^\]"]*+)*+\])++)'
RFC5424 = rf"(?s)^<(\d{{1,3}})>\d{{1,2}} (\S++) (\S++) (\S++) (\S++) (\S++) ({_SD})(?: (.*))?\z"
# RFC 3164: [<pri>]Mon dd HH:MM:SS host [app[pid]:] message.
RFC3164 = r"(?s)^(?:<(\d{1,3})>)?([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) (\S++) ?(?:([^\s:\[,]++)(?:\[(\d++)\])?: )?(.*)\z"
PAIR = r'([^\s="\[\]]++)="([^"\\]*+(?:\\.[^"\\]*+)*+)"'
# Field separators inside the one replacement that takes a header apart.
_FS, _MODERN, _LEGACY = "\x1f", "\x1eA", "\x1eB"

EMPTY_MAP = "map<string,string>"


def no_entries() -> Column:
    return F.create_map().cast(EMPTY_MAP)


def found(value: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, NULL when the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def parse_syslog_header(df: DataFrame, message: str = "message", received_at: str = "received_at") -> DataFrame:
    """Adds the header fields of both syslog forms; ``parsed`` is false when neither fits.

    Each line meets each pattern once: a match is rewritten into separated
    fields, which are then split, instead of one extraction per field.
    """
    m = F.col(message)

    def fields(pattern: str, mark: str, groups: tuple[str, ...]) -> Column:
        return F.split(F.regexp_replace(m, pattern, mark + "".join(_FS + g for g in groups)), _FS, len(groups) + 1)

    # Both forms in the order: priority, time, host, program, process, message id, data, text.
    modern = fields(RFC5424, _MODERN, tuple(f"${i}" for i in range(1, 9)))
    legacy = fields(RFC3164, _LEGACY, ("$1", "$2", "$3", "$4", "$5", "", "", "$6"))
    df = df.withColumn("_h", F.when(m.startswith("<"), modern))
    df = df.withColumn("_h", F.when(F.col("_h")[0] == _MODERN, F.col("_h")).otherwise(legacy))
    kind = F.col("_h")[0]
    parsed = kind.isin(_MODERN, _LEGACY)

    def part(i: int) -> Column:
        value = F.try_element_at("_h", F.lit(i + 1))
        return F.when(parsed, F.nullif(F.nullif(value, F.lit("-")), F.lit("")))

    stamp = F.regexp_replace(part(2), " +", " ")
    at = F.try_to_timestamp(F.concat(F.year(received_at).cast("string"), F.lit(" "), stamp), F.lit("yyyy MMM d HH:mm:ss"))
    out = df.withColumn("header_ts", F.when(kind == _MODERN, F.try_to_timestamp(part(2))).when(kind == _LEGACY, at))
    # The legacy form has no year; a line from the future belongs to last year.
    late = (kind == _LEGACY) & (F.col("header_ts") > F.col(received_at) + F.expr("INTERVAL 1 DAY"))
    return out.withColumns({
        "header_ts": F.when(late, F.col("header_ts") - F.expr("INTERVAL 1 YEAR")).otherwise(F.col("header_ts")),
        "priority": part(1).try_cast("int"), "hostname": part(3), "appname": part(4), "procid": part(5), "msgid": part(6),
        "structured_data": part(7), "body": F.when(parsed, F.try_element_at("_h", F.lit(9))), "parsed": F.coalesce(parsed, F.lit(False)),
    }).drop("_h")


def keep_if(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that stays where it is.

    The optimizer moves an ordinary filter below the projections it reads and
    repeats their expressions inside it, so every line would be parsed again
    for each mention of a parsed field.  A generator is not moved.
    """
    once = F.when(condition, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("_keep", F.explode(once)).drop("_keep")


def structured_data_map(data: Column) -> Column:
    """The ``key="value"`` pairs of structured data; a repeated key keeps its last value.

    Escaped quotes belong to their value.
    """
    text = F.coalesce(data, F.lit(""))
    return F.map_from_arrays(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)))


def param(fields: Column, name: str) -> Column:
    """A parameter cut at its first quote, NULL when absent or empty."""
    return F.nullif(F.split_part(fields[name], F.lit('"'), F.lit(1)), F.lit(""))


def escaped_param(fields: Column, name: str) -> Column:
    """A whole parameter, escaped quotes included, NULL when absent or empty."""
    return F.nullif(fields[name], F.lit(""))


def known_device(hostname: Column, devices: tuple[str, ...] | None = None) -> Column:
    """The host name when its first label is one of ``devices``, else ''.  Without a list every name stays.

    For a list that is a table, see ``known_device_gate``.  The label must equal a known name, so a longer name with a known prefix fails.
    """
    host = F.coalesce(hostname, F.lit(""))
    if devices is None:
        return host
    label = F.lower(F.split_part(host, F.lit("."), F.lit(1)))
    return F.when(label.isin(*devices), host).otherwise("")


def known_device_gate(df: DataFrame, devices: DataFrame, hostname: str = "hostname") -> DataFrame:
    """The gate against a device table ``(device)`` instead of a fixed list."""
    known = devices.select(F.lower("device").alias("_label")).distinct().withColumn("_known", F.lit(True))
    labelled = df.withColumn("_label", F.lower(F.split_part(F.coalesce(F.col(hostname), F.lit("")), F.lit("."), F.lit(1))))
    joined = labelled.join(known, "_label", "left")
    return joined.withColumn(hostname, F.when(F.col("_known"), F.col(hostname)).otherwise("")).drop("_label", "_known")




def ext_map(*pairs: tuple[str, Column]) -> Column:
    """A map of the entries whose value is neither NULL nor empty."""
    built = F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(built, lambda _k, v: v.isNotNull() & (v != ""))


# Columns a branch may leave out, with the value an absent field has.
_DEFAULTS: dict[str, str] = {
    "event_kind": "event", "event_action": "unknown", "event_outcome": "unknown", "network_transport": "", "rule_name": "",
    "observer_ingress_zone": "", "observer_egress_zone": "", "observer_hostname": "", "user_name": "",
}


def event_rows(df: DataFrame, feed: str, provider: str, **columns: Column) -> DataFrame:
    """Canonical event rows from expressions; fields not given take their defaults."""
    given = {
        "event_id": event_id(F.lit(feed), F.col("received_at"), F.col("message")), "tenant_id": F.lit(DEFAULT_TENANT),
        "event_provider": F.lit(provider), "timestamp": F.col("received_at"), "raw": F.col("message"), **columns,
    }
    out = []
    for f in schemas.EVENTS.fields:
        if f.name in given:
            value = given[f.name]
            if f.name in _DEFAULTS:
                value = F.coalesce(value, F.lit(_DEFAULTS[f.name]))
        elif f.name in _DEFAULTS:
            value = F.lit(_DEFAULTS[f.name])
        elif f.name == "ext":
            value = no_entries()
        else:
            value = F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def port(value: Column) -> Column:
    """A port in range, else NULL."""
    n = value.try_cast("int")
    return F.when(n.between(0, 65535), n)
