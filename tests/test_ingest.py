import pytest

from netfabric.plans.normalise import normalise_events
from netfabric.sources import syslog

KEY = b"test-key"
SD = "[junos@2636.1.1.1.2.129 "

# (feed, line, expected fields); None as expectation means the line is dropped.
CASES = {
    "session create has no byte counts": ("srx", f'<14>1 2026-06-05T12:00:00Z vsrx-prod RT_FLOW - RT_FLOW_SESSION_CREATE {SD}source-address="10.0.0.1" source-port="5" destination-address="10.0.0.2" destination-port="53" protocol-id="17"]',
        {"event_action": "flow_session_create", "event_outcome": "success", "network_transport": "udp", "source_bytes": 0, "network_bytes": 0, "source_port": 5}),
    "session deny blanks N/A user": ("srx", f'<14>1 2026-06-05T12:00:00Z vsrx-prod RT_FLOW - RT_FLOW_SESSION_DENY {SD}username="N/A" protocol-id="1" policy-name="deny-all"]',
        {"event_action": "flow_session_deny", "event_outcome": "failure", "user_name": "", "rule_name": "deny-all", "network_transport": "icmp"}),
    "unknown RT id falls back to its name": ("srx", f'<14>1 2026-06-05T12:00:00Z h RT_UTM - RT_UTM_EVENT {SD}a="b"]', {"event_action": "rt_utm_event", "event_outcome": "unknown"}),
    "application tracking under RT_FLOW is kept": ("srx", f'<14>1 2026-06-05T12:00:00Z h RT_FLOW - APPTRACK_SESSION_CLOSE {SD}a="b"]', {"event_action": "unknown"}),
    "screen without attack name": ("srx", f'<14>1 2026-06-05T12:00:00Z h RT_IDS - RT_SCREEN_ICMP {SD}a="b"]', {"event_action": "screen", "event_kind": "alert", "event_outcome": "failure"}),
    "IPv6 stays in ext": ("srx", f'<14>1 2026-06-05T12:00:00Z h RT_FLOW - RT_FLOW_SESSION_CLOSE {SD}source-address="fe80::1" destination-address="10.0.0.2"]', {"source_ip": None, "destination_ip": "10.0.0.2", "ext:source-address": "fe80::1"}),
    "garbage is a parse error": ("srx", "not syslog at all", {"event_action": "parse_error", "event_kind": "event", "raw": "not syslog at all"}),
    "known host by first label": ("srx", f'<14>1 2026-06-05T12:00:00Z VSRX-BR07.lab.example RT_FLOW - RT_FLOW_SESSION_CLOSE {SD}a="b"]', {"observer_hostname": "VSRX-BR07.lab.example"}),
    "prefix spoof fails the gate": ("srx", f'<14>1 2026-06-05T12:00:00Z vsrx-prod-evil RT_FLOW - RT_FLOW_SESSION_CLOSE {SD}a="b"]', {"observer_hostname": ""}),
    "process noise on the shared port is dropped": ("srx", "<30>1 2026-06-05T12:00:00Z vsrx-prod kernel - - - link up", None),
    "audit record on the shared port": ("srx", f'<30>1 2026-06-05T12:00:00Z vsrx-prod mgd 7 UI_LOGIN_EVENT {SD}username="al"] text', {"event_action": "auth_login", "user_name": "al", "observer_hostname": "vsrx-prod"}),
    "firewall deny": ("panos", "<14>Jun  5 12:00:00 panosvm ,2026/06/05 12:00:00,01,TRAFFIC,deny,1,2026/06/05 11:00:00,10.0.0.1,10.0.0.2,0.0.0.0,0.0.0.0,r,u1,,web,v,a,b,e,e,l,,9,1,1,2,0,0,f,tcp,reset-both,1,2,3",
        {"event_action": "flow_deny", "event_outcome": "failure", "user_name": "u1", "source_port": 1, "network_bytes": 1}),
    "firewall config": ("panos", "<14>Jun  5 12:00:00 panosvm ,2026/06/05 12:00:00,01,CONFIG,0,1,2026/06/05 11:00:00,10.9.9.9,,set,admin,Web,Succeeded", {"event_action": "config_0", "user_name": "admin", "ext:panw.panos.command": "set", "ext:panw.panos.result": "Succeeded"}),
    "other log type": ("panos", "<14>Jun  5 12:00:00 panosvm ,2026/06/05 12:00:00,01,GLOBALPROTECT,,1,2026/06/05 11:00:00", {"event_action": "globalprotect", "ext:panw.panos.type": "GLOBALPROTECT"}),
    "short line": ("panos", "<14>Jun  5 12:00:00 panosvm ,x", {"event_action": "unknown", "event_provider": "paloalto"}),
    "IPv6 source in firewall traffic": ("panos", "<14>Jun  5 12:00:00 panosvm ,2026/06/05 12:00:00,01,TRAFFIC,end,1,2026/06/05 11:00:00,fe80::1,10.0.0.2", {"event_action": "flow_end", "source_ip": None, "destination_ip": "10.0.0.2", "event_outcome": "unknown", "network_transport": "unknown"}),
    "detection, observer from the payload": ("unifi", "Jun  5 12:00:00 spoofed CEF:0|Ubiquiti|UniFi Network|9|200|Threat Detected|5|act=detected UNIFIdeviceName=Gateway UNIFIutcTime=2026-06-05T11:00:00.250Z dst=999.1.1.1\n",
        {"event_action": "alert", "event_outcome": "detection", "observer_hostname": "Gateway", "destination_ip": None, "ext:unifi.dst_addr": "999.1.1.1", "source_port": None}),
    "non-threat CEF is dropped": ("unifi", "Jun  5 12:00:00 c CEF:0|Ubiquiti|UniFi Network|9|400|Admin Login|1|a=b", None),
    "cut CEF is a parse error": ("unifi", "Jun  5 12:00:00 c CEF:0|Ubiquiti|UniFi|Threat Detected|5", {"event_action": "parse_error"}),
    "ssh accepted from IPv6": ("proxmox", "<38>1 2026-06-05T14:00:00+02:00 pve3 sshd 1 - - Accepted publickey for root from fe80::9 port 51000 ssh2: K", {"event_action": "auth_success", "user_name": "root", "source_ip": None, "ext:proxmox.source_addr": "fe80::9", "source_port": 51000}),
    "pam line is dropped": ("proxmox", "<38>1 2026-06-05T14:00:00Z pve3 systemd 1 - - authentication failure; logname= uid=0", None),
    "task start": ("proxmox", "<38>1 2026-06-05T14:00:00Z pve3 pct 1 - - <root@pam> starting task UPID:pve3:0A:0B:0C:vzstart:109:root@pam:", {"event_action": "task_vzstart", "ext:proxmox.vmid": "109", "user_name": "root@pam", "event_outcome": "unknown"}),
    "web login": ("proxmox", "<38>1 2026-06-05T14:00:00Z pve3 pvedaemon 1 - - <root@pam> successful auth for user 'ops@pve'\n", {"event_action": "auth_success", "user_name": "ops@pve", "ext:proxmox.realm": "pve"}),
    "threshold hashes the user": ("junos_sys", f'<38>1 2026-06-05T14:00:00Z vsrx-ci sshd 1 SSHD_LOGIN_ATTEMPTS_THRESHOLD {SD}limit="3" username="eve"] Threshold for eve', {"event_action": "auth_attempts_threshold", "ext:junos.sys.limit": "3", "not_in_raw": "eve"}),
    "sshd accepted free text": ("junos_sys", "<38>1 2026-06-05T14:00:00Z vsrx-ci sshd 1 - - Accepted publickey for admin from 198.51.100.1 port 50000 ssh2", {"event_action": "auth_success", "user_name": "admin", "source_ip": "198.51.100.1"}),
    "secret set without values": ("junos_sys", f'<38>1 2026-06-05T14:00:00Z vsrx-ci mgd 1 UI_CFG_AUDIT_SET_SECRET {SD}username="al" action="set" pathname="[system x]"] t', {"event_action": "configuration_change", "ext:junos.sys.secret": "true"}),
    "old and new secret with escaped quote": ("junos_sys", f'<38>1 2026-06-05T14:00:00Z vsrx-ci mgd 1 UI_CFG_AUDIT_SET {SD}username="al" pathname="[x pre-shared-key]" data="o\\"ld" value="n\\"ew"] o\\"ld n\\"ew', {"ext:junos.sys.data": "[REDACTED]", "ext:junos.sys.value": "[REDACTED]", "not_in_raw": "ld"}),
    "community name in the path": ("junos_sys", f'<38>1 2026-06-05T14:00:00Z vsrx-ci mgd 1 UI_CFG_AUDIT_OTHER {SD}username="al" pathname="[snmp community topsecret]" value="x"] topsecret', {"ext:junos.sys.pathname": "[snmp community [REDACTED]]", "not_in_raw": "topsecret"}),
    "plain change is shown": ("junos_sys", f'<38>1 2026-06-05T14:00:00Z vsrx-ci mgd 1 UI_CFG_AUDIT_SET {SD}username="al" pathname="[interfaces mtu]" data="1500" value="9000"] t', {"ext:junos.sys.value": "9000", "ext:junos.sys.data": "1500"}),
    "encrypted marker anywhere": ("junos_sys", f'<38>1 2026-06-05T14:00:00Z vsrx-ci mgd 1 UI_COMMIT {SD}username="al" message="m"] leaked $9$abcDEF/1', {"not_in_raw": "$9$"}),
    "progress chatter is dropped": ("junos_sys", f'<38>1 2026-06-05T14:00:00Z vsrx-ci mgd 1 UI_COMMIT_PROGRESS {SD}message="x"] t', None),
}


DEVICES = ("vsrx-prod", *(f"vsrx-br{n:02d}" for n in range(1, 13)))


@pytest.fixture(scope="module")
def normalised(spark, at):
    rows = [(at("2026-06-05 13:00:00"), feed, line) for feed, line, _ in CASES.values()]
    raw = spark.createDataFrame(rows, "received_at timestamp, feed string, message string")
    from netfabric.functions.ids import event_id
    from pyspark.sql import functions as F
    feeds = spark.createDataFrame([(n, f, m) for n, (f, m, _) in CASES.items()], "case string, feed string, message string").withColumn("received_at", F.lit("2026-06-05 13:00:00").cast("timestamp"))
    keyed = feeds.select("case", F.explode(F.array(F.col("feed"), F.lit("junos_sys"))).alias("f"), "received_at", "message").distinct()
    names = {r.id: r.case for r in keyed.select("case", event_id(F.col("f"), F.col("received_at"), F.col("message")).alias("id")).collect()}
    return {names[r.event_id]: r for r in normalise_events(raw, KEY, DEVICES).collect()}


@pytest.mark.parametrize("case", CASES)
def test_case(normalised, case):
    expected = CASES[case][2]
    row = normalised.get(case)
    if expected is None:
        assert row is None
        return
    assert row is not None
    for field, value in expected.items():
        if field == "not_in_raw":
            assert value not in row.raw
        elif field.startswith("ext:"):
            assert row.ext[field[4:]] == value
        else:
            assert row[field] == value, field


def test_legacy_header_year_comes_from_receipt(spark, at):
    df = spark.createDataFrame([(at("2026-01-01 00:10:00"), "Dec 31 23:59:00 host app[3]: text"), (at("2026-06-05 00:10:00"), "<5>Jun  4 23:59:00 host text")], "received_at timestamp, message string")
    got = syslog.parse_syslog_header(df).orderBy("received_at").collect()
    assert [str(r.header_ts) for r in got] == ["2025-12-31 23:59:00", "2026-06-04 23:59:00"]
    assert (got[0].appname, got[0].procid, got[0].body, got[1].priority) == ("app", "3", "text", 5)


def test_long_structured_data_does_not_overflow(spark, at):
    line = f'<14>1 2026-06-05T12:00:00Z vsrx-ci RT_FLOW - RT_FLOW_SESSION_CLOSE {SD}' + " ".join(f'k{i}="{"v" * 50}"' for i in range(1500)) + "]"
    df = spark.createDataFrame([(at("2026-06-05 13:00:00"), "srx", line)], "received_at timestamp, feed string, message string")
    row = normalise_events(df, KEY).first()
    assert row.event_action == "flow_session_close" and len(row.ext) == 1500


def test_without_a_device_list_every_host_keeps_its_name(spark, at):
    line = f'<14>1 2026-06-05T12:00:00Z edge-fw-01.corp RT_FLOW - RT_FLOW_SESSION_CLOSE {SD}a="b"]'
    df = spark.createDataFrame([("srx", line, at("2026-06-05 12:00:00"))], "feed string, message string, received_at timestamp")
    assert [r.observer_hostname for r in normalise_events(df, KEY).collect()] == ["edge-fw-01.corp"]
