"""All feeds to one event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfabric.sources.junos_audit import normalise_junos_audit
from netfabric.sources.panos import normalise_panos
from netfabric.sources.proxmox import normalise_proxmox
from netfabric.sources.srx import normalise_srx
from netfabric.sources.unifi import normalise_unifi


def route_feeds(raw: DataFrame) -> dict[str, DataFrame]:
    """Raw lines per normaliser.

    The shared security port also carries audit records; the two normalisers
    keep disjoint sets of lines, so it is handed to both.  With the raw table
    partitioned by feed each branch reads only its own folders.
    """
    feed = F.col("feed")
    return {
        "srx": raw.filter(feed == "srx"), "panos": raw.filter(feed == "panos"), "unifi": raw.filter(feed == "unifi"),
        "proxmox": raw.filter(feed == "proxmox"), "junos_audit": raw.filter(feed.isin("junos_sys", "srx")),
    }


def normalise_events(raw: DataFrame, hash_key: bytes, devices: tuple[str, ...] | None = None) -> DataFrame:
    """Every feed normalised; no shuffle, batch and streaming alike."""
    feeds = route_feeds(raw)
    parts = [
        normalise_srx(feeds["srx"], devices), normalise_panos(feeds["panos"], devices), normalise_unifi(feeds["unifi"]),
        normalise_proxmox(feeds["proxmox"], hash_key), normalise_junos_audit(feeds["junos_audit"], hash_key, devices),
    ]
    return reduce(DataFrame.unionByName, parts)
