"""Identity hashes, keyed hashes and tokens, all as native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TENANT = "t_main"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text(value: Column | str) -> Column:
    """``value`` as a string with NULL read as the empty string."""
    return F.coalesce(_col(value).cast("string"), F.lit(""))


def hash16(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined with ``|``."""
    joined = F.concat_ws("|", *[text(p) for p in parts])
    return F.substring(F.sha1(joined), 1, 16)


def node_id(tenant: Column, kind: Column, key: Column) -> Column:
    return hash16(tenant, kind, key)


def graph_edge_id(
    tenant: Column, src: Column, dst: Column, edge_type: Column, layer: Column
) -> Column:
    return hash16(tenant, src, dst, edge_type, layer)


def entity_id(tenant: Column, kind: Column, key: Column) -> Column:
    return hash16(tenant, F.lit("entity"), kind, key)


def entity_edge_id(
    tenant: Column, src: Column, dst: Column, edge_type: Column, source: Column
) -> Column:
    return hash16(tenant, F.lit("entity_edge"), src, dst, edge_type, source)


def hmac_sha256(message: Column | str, key: bytes) -> Column:
    """Lower-case hex HMAC-SHA256 of a string column, built from two SHA-256 passes.

    The padded key is part of the plan.  Set ``spark.sql.redaction.string.regex``
    on clusters whose plans are shown to people who may not see it.
    """
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(64, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in padded))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in padded))
    body = F.encode(_col(message), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(inner_pad, body), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def dedup_token(server: Column | str, run: Column | str, seq: Column | str) -> Column:
    """``<bytes>:server:<bytes>:run:seq``; the lengths count UTF-8 bytes."""
    s, r = text(server), text(run)
    return F.concat(
        F.octet_length(s).cast("string"), F.lit(":"), s, F.lit(":"),
        F.octet_length(r).cast("string"), F.lit(":"), r, F.lit(":"), text(seq),
    )


def event_id(feed: Column | str, received_at: Column | str, message: Column | str) -> Column:
    """Replay-stable event id: the same datagram always gets the same id."""
    return F.sha1(F.concat_ws("|", text(feed), text(received_at), text(message)))
