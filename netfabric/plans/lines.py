"""Raw log lines rendered from the event table, one per event, in each feed's own format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netfabric.plans import adapter as ad

BS = chr(92)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.spread(ad.view(spark, sf_dir, "net_events")).withColumns({
        "iso": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "bsd": F.date_format("timestamp", "MMM dd HH:mm:ss"),
        "n": F.col("event_no"), "sent": F.coalesce("network_bytes", F.lit(0)), "got": F.col("event_no") % 1000,
    })


def _line(df: DataFrame, feed: str, message: Column) -> DataFrame:
    return df.select("event_no", F.col("timestamp").alias("received_at"), F.lit(feed).alias("feed"), message.alias("message"))


def _kv(**pairs: Column) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f'{k.replace("_", "-")}="'), v.cast("string"), F.lit('"')) for k, v in pairs.items()])


def srx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _base(spark, sf_dir)
    t = F.col("event_type")
    msgid = (
        F.when(t == "view", "RT_FLOW_SESSION_CREATE").when(t == "click", "RT_FLOW_SESSION_CLOSE")
        .when(t == "purchase", "APPTRACK_SESSION_CLOSE").when(t == "signup", "RT_SCREEN_TCP").otherwise("RT_FLOW_SESSION_DENY")
    )
    host = F.when(F.col("n") % 11 == 0, F.lit("vsrx-br01x.lab")).otherwise(F.concat(F.lit("vsrx-br0"), (F.col("n") % 3 + 1).cast("string"), F.lit(".lab")))
    fields = _kv(
        attack_name=F.concat(F.lit("SYN flood #"), (F.col("n") % 4).cast("string")), source_address=F.col("source_ip"),
        source_port=F.col("source_port"), destination_address=F.coalesce("destination_ip", F.lit("fe80::1")),
        destination_port=F.col("destination_port"), protocol_id=F.when(F.col("network_transport") == "udp", 17).otherwise(6),
        policy_name=F.col("rule_name"), source_zone_name=F.col("observer_ingress_zone"), destination_zone_name=F.col("observer_egress_zone"),
        username=F.when(F.col("n") % 4 == 0, "N/A").otherwise(F.col("user_name")), bytes_from_client=F.col("sent"), bytes_from_server=F.col("got"),
    )
    message = F.concat(F.lit("<14>1 "), "iso", F.lit(" "), host, F.lit(" RT_FLOW - "), msgid, F.lit(" [junos@2636.1.1.1.2.129 "), fields, F.lit("]"))
    return _line(df, "srx", message)


def panos_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _base(spark, sf_dir)
    t = F.col("event_type")
    kind = F.when(t.isin("view", "click"), "TRAFFIC").when(t == "purchase", "THREAT").when(t == "signup", "CONFIG").otherwise("SYSTEM")
    sub = F.when(t == "view", "start").when(t == "click", "end").when(t == "purchase", "url").when(t == "signup", "0").otherwise("general")
    e = F.lit("")
    s = lambda c: F.coalesce(F.col(c).cast("string"), e)
    flow = [
        s("source_ip"), s("destination_ip"), F.lit("0.0.0.0"), F.lit("192.0.2.9"), s("rule_name"), F.lit("N/A"), e, F.lit("web"), F.lit("vsys1"),
        s("observer_ingress_zone"), s("observer_egress_zone"), e, e, e, e, s("n"), e, s("source_port"), s("destination_port"), e, e, e,
        F.upper("network_transport"), F.when(F.col("n") % 3 == 0, "reset-both").otherwise("allow"),
        F.when(t == "purchase", F.concat(F.lit("misc"), e)).otherwise((F.col("sent") + F.col("got")).cast("string")),
        F.when(t == "purchase", F.lit("threat-7")).otherwise(s("sent")), F.when(t == "purchase", F.lit("spyware")).otherwise(s("got")),
        F.when(t == "purchase", F.lit("critical")).otherwise(e), F.lit("client-to-server"),
    ]
    short = [F.lit("f7"), F.lit("ev-id"), F.lit("set"), s("user_name"), F.lit("Web"), F.lit("module"), F.lit("high")]
    head = [e, F.lit("2024/01/01 00:00:00"), F.lit("0123"), kind, sub, e, F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss")]
    csv = F.when(t.isin("view", "click", "purchase"), F.concat_ws(",", *head, *flow)).otherwise(F.concat_ws(",", *head, *short))
    return _line(df, "panos", F.concat(F.lit("<14>"), "bsd", F.lit(" panosvm "), csv))


def unifi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _base(spark, sf_dir)
    name = F.when(F.col("n") % 7 == 0, "Admin Login").otherwise("Threat Detected")
    ext = F.concat(
        F.lit("act="), F.when(F.col("n") % 2 == 0, "Blocked").otherwise("detected"), F.lit(" proto="), F.upper("network_transport"),
        F.lit(" spt="), F.col("source_port").cast("string"), F.lit(" dpt="), F.col("destination_port").cast("string"),
        F.lit(" dst="), F.coalesce("destination_ip", F.lit("fe80::2")), F.lit(" UNIFIpolicyName=Scanning Activity "),
        F.col("event_type"), F.lit(" UNIFIdeviceName=Gateway Max UNIFIipsSignature=ET SCAN a"), F.lit(BS), F.lit("=b number "), F.col("n").cast("string"),
        F.lit(" UNIFIutcTime="), "iso", F.lit(" UNIFItotalBytes="), F.col("sent").cast("string"),
    )
    message = F.concat("bsd", F.lit(" controller CEF:0|Ubiquiti|UniFi Network|9.1|200|"), name, F.lit("|7|"), ext, F.lit("\n"))
    return _line(df, "unifi", message)


def proxmox_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _base(spark, sf_dir)
    t = F.col("event_type")
    peer = F.concat(F.lit(" from "), "source_ip", F.lit(" port "), F.col("source_port").cast("string"), F.lit(" ssh2"))
    app = F.when(F.col("n") % 7 == 0, "kernel").when(t == "view", "sshd").when(t == "click", "sshd-session").otherwise("pvedaemon")
    body = (
        F.when(t == "view", F.concat(F.lit("Accepted publickey for "), "user_name", peer))
        .when(t == "click", F.concat(F.lit("Failed password for invalid user "), "user_name", peer))
        .when(t == "purchase", F.concat(F.lit("<root@pam> end task UPID:pve3:0001:0002:0003:qmstart:"), F.col("n").cast("string"), F.lit(":"), "user_name", F.lit("@pam: "),
                                        F.when(F.col("n") % 2 == 0, "OK").otherwise("unexpected status")))
        .when(t == "signup", F.concat(F.lit("<root@pam> successful auth for user '"), "user_name", F.lit("@pve'")))
        .otherwise(F.concat(F.lit("authentication failure; rhost=::ffff:10.9.9.9 user="), "user_name", F.lit("@pam msg=no such user")))
    )
    return _line(df, "proxmox", F.concat(F.lit("<38>1 "), "iso", F.lit(" pve3 "), app, F.lit(" 77 - - "), body))


def junos_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _base(spark, sf_dir)
    t = F.col("event_type")
    user = F.concat(F.lit('username="'), "user_name", F.lit('" '))
    secret = F.concat(F.lit("pw-"), F.col("n").cast("string"))
    path = F.when(F.col("n") % 3 == 0, F.concat(F.lit("[snmp community name-"), F.col("n").cast("string"), F.lit(" authorization]"))).when(
        F.col("n") % 3 == 1, F.lit("[system radius-server 192.0.2.1 secret]")
    ).otherwise(F.lit("[interfaces ge-0/0/0 mtu]"))
    msgid = (
        F.when(t == "view", "UI_COMMIT").when(t == "click", "UI_CFG_AUDIT_SET").when(t == "purchase", "SSHD_LOGIN_FAILED")
        .when(t == "signup", "UI_LOGIN_EVENT").otherwise("UI_COMMIT_PROGRESS")
    )
    params = (
        F.when(t == "view", F.concat(user, F.lit('command="commit" message="change '), F.col("n").cast("string"), F.lit('"')))
        .when(t == "click", F.concat(user, F.lit('action="set" pathname="'), path, F.lit('" data="old-'), secret, F.lit('" value="'), secret, F.lit(f'{BS}"q"')))
        .when(t == "purchase", F.concat(user, F.lit('source-address="'), "source_ip", F.lit('"'))).otherwise(F.concat(user, F.lit('x="1"')))
    )
    tail = F.when(t == "click", F.concat(F.lit("] set: "), path, F.lit(" <old-"), secret, F.lit("> -> "), secret, F.lit(f'{BS}"q $9$zz'), F.col("n").cast("string"))).otherwise("] text")
    message = F.concat(F.lit("<37>1 "), "iso", F.lit(" vsrx-ci.lab mgd 1 "), msgid, F.lit(" [junos@2636.1.1.1.2.129 "), params, tail)
    return _line(df, "junos_sys", message)


LINES = {"srx": srx_lines, "panos": panos_lines, "unifi": unifi_lines, "proxmox": proxmox_lines, "junos_sys": junos_lines}


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in every feed's format."""
    out = None
    for make in LINES.values():
        part = make(spark, sf_dir)
        out = part if out is None else out.unionByName(part)
    return out
