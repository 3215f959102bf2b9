"""Hashing of failed-login names and redaction of secrets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netfabric.functions.ids import hmac_sha256
from netfabric.sources.syslog import found

# Which parts of a configuration path lead to a secret.  A part is what stands between
# blanks, dashes and brackets: login and tunnel statements, key encodings, SNMP names.
SECRET_PARTS = {"key": False, "psk": True, "password": True, "secret": True, "private": True, "hexadecimal": True, "community": True}
SECRET_ENCODING = "ascii-text"
ENCRYPTED = r"^\$[0-9]+\$"
ENCRYPTED_ANYWHERE = r'\$[0-9]+\$[^\s"\\\]]+'
# The name ends at the closing bracket too, so that its other mentions are found.
COMMUNITY_NAME = r"community\s+([^\s\\\]]+)"
HASHED, REDACTED = "[HASHED]", "[REDACTED]"


def _scrub(text: Column, value: Column, mark: str) -> Column:
    """``text`` with every literal occurrence of ``value`` marked; NULL or empty values scrub nothing."""
    usable = value.isNotNull() & (value != "")
    return F.when(usable, F.replace(text, value, F.lit(mark))).otherwise(text)


def hash_user(user: Column, key: bytes) -> Column:
    """Keyed hash of a failed login's user: such names are often mistyped real ones."""
    return F.when(user.isNotNull() & (user != ""), hmac_sha256(user, key))


def scrub_user(raw: Column, user: Column) -> Column:
    return _scrub(raw, user, HASHED)


def scrub_secret(text: Column, secret: Column) -> Column:
    return _scrub(text, secret, REDACTED)


def community_name(path: Column) -> Column:
    return found(path, COMMUNITY_NAME)


def redact_community(text: Column, path: Column) -> Column:
    """A community name is a secret by itself and stands in the path."""
    return _scrub(text, community_name(path), REDACTED)


def leads_to_secret(path: Column) -> Column:
    """Whether a part of the path is ``key``, or holds one of the other words of ``SECRET_PARTS``."""
    parts = F.split(F.lower(path), "[^a-z0-9_]+")

    def telling(part: Column) -> Column:
        hit = F.lit(False)
        for word, inside in SECRET_PARTS.items():
            hit = hit | (part.contains(word) if inside else part == word)
        return hit

    return F.exists(parts, telling) | F.lower(path).contains(SECRET_ENCODING)


def is_secret(path: Column, value: Column) -> Column:
    """The value belongs under a secret-shaped path or is already encrypted."""
    shaped = F.coalesce(leads_to_secret(path), F.lit(False)) | F.coalesce(value.rlike(ENCRYPTED), F.lit(False))
    return value.isNotNull() & shaped


def shown_value(path: Column, value: Column) -> Column:
    return F.when(is_secret(path, value), F.lit(REDACTED)).otherwise(value)


def redact_value(raw: Column, path: Column, value: Column) -> Column:
    return F.when(is_secret(path, value), _scrub(raw, value, REDACTED)).otherwise(raw)


def redact_leftovers(raw: Column) -> Column:
    """Last net: any encrypted marker still in the line."""
    return F.when(raw.contains("$"), F.regexp_replace(raw, ENCRYPTED_ANYWHERE, REDACTED)).otherwise(raw)
