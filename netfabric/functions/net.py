"""Address and host-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address patterns.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4_PATTERN = rf"^{OCTET}(?:\.{OCTET}){{3}}\z"
MAC_PATTERN = r"^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\z"
MAC_PREFIX_PATTERN = r"^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_ipv4(value: Column | str) -> Column:
    return F.coalesce(_col(value).rlike(IPV4_PATTERN), F.lit(False))


def is_ip(value: Column | str) -> Column:
    """IPv4, or something with the colons of an IPv6 address."""
    v = _col(value)
    return is_ipv4(v) | F.coalesce(
        v.rlike(r"^[0-9A-Fa-f:.]+(?:%[\w.]+)?\z") & v.contains(":") & ~v.rlike(MAC_PATTERN),
        F.lit(False),
    )


def is_mac(value: Column | str) -> Column:
    return F.coalesce(_col(value).rlike(MAC_PATTERN), F.lit(False))


def ipv4_or_null(value: Column | str) -> Column:
    """The value when it is an octet-bounded IPv4 address, else NULL."""
    v = _col(value)
    return F.when(v.rlike(IPV4_PATTERN), v)


def lookup_form(value: Column | str) -> Column:
    """MAC-shaped lookups in lower case (as stored); everything else unchanged."""
    v = _col(value)
    return F.when(is_mac(v), F.lower(v)).otherwise(v)


def short_host(value: Column | str) -> Column:
    """First DNS label with its case kept; an IP address is left whole."""
    v = _col(value)
    return F.when(is_ip(v), v).otherwise(F.split_part(v, F.lit("."), F.lit(1)))


def segment(value: Column | str) -> Column:
    """Vantage name reduced to its first label, trimmed, lower case; empty is ``unknown``."""
    label = F.lower(F.trim(F.split_part(F.coalesce(_col(value), F.lit("")), F.lit("."), F.lit(1))))
    return F.when(label == "", F.lit("unknown")).otherwise(label)
