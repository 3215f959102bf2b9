import json

from netfabric.sources import gauges as g
from netfabric.sources import rulebases as r
from netfabric.sources import snapshots as s


def rows(df, *cols):
    return sorted(tuple(x) for x in df.select(*cols).collect())


def test_arp_text_skips_header_and_footer(snap):
    body = "MAC Address       Address    Interface  Flags\nAA:BB:CC:00:00:01 10.0.0.5 ge-0/0/0.0 none\n\nTotal entries: 1\nshort line\n"
    df = s.arp_from_text(snap(("juniper", "fw1", "show arp no-resolve", body)))
    assert rows(df, "subj_id", "obj_id", "layer") == [("ip:10.0.0.5", "mac:aa:bb:cc:00:00:01", "l3")]
    assert df.first()["attrs"] == {"interface": "ge-0/0/0.0"}


def test_lldp_text_port_with_spaces(snap):
    body = "Local Interface Parent Interface Chassis Id Port info System Name\nge-0/0/1 - 02:00:00:00:00:09 Port 7 uplink sw-core\nge-0/0/2 - 02:00:00:00:00:0a sw-edge\n"
    df = s.lldp_from_text(snap(("juniper", "fw1", "show lldp neighbors", body)))
    assert rows(df, "subj_id", "obj_id") == [
        ("if:fw1:ge-0/0/1", "if:sw-core:Port 7 uplink"), ("if:fw1:ge-0/0/2", "if:sw-edge:unknown"),
    ]


def test_mac_table_needs_a_mac_in_second_place(snap):
    body = "Vlan MAC flags age port\nv10 02:00:00:AA:00:01 D - ge-0/0/3.0\nname one two three four\n"
    df = s.mac_table_from_text(snap(("juniper", "sw1", "x", body)))
    assert rows(df, "subj_id", "obj_id") == [("mac:02:00:00:aa:00:01", "device:sw1")]


def test_arp_xml_in_envelope_drops_incomplete(snap):
    xml = "<response><result><entries><entry><ip>10.0.0.1</ip><mac>02:00:00:00:00:FF</mac><interface>e1</interface></entry><entry><ip>10.0.0.2</ip><mac>(incomplete)</mac></entry></entries></result></response>"
    df = s.arp_from_xml(snap(("paloalto", "pan", "show arp all", json.dumps({"result": xml}))))
    assert rows(df, "subj_id", "obj_id") == [("ip:10.0.0.1", "mac:02:00:00:00:00:ff")]


def test_lldp_xml_name_attribute_and_unknown_system(snap):
    xml = '<r><entry name="ethernet1/1"><port-id>p9</port-id></entry><entry name="e2"/></r>'
    df = s.lldp_from_xml(snap(("paloalto", "pan", "x", xml)))
    assert rows(df, "subj_id", "obj_id") == [("if:pan:ethernet1/1", "if:unknown:p9")]


def test_clients_json_wired_wireless_and_address(snap):
    body = json.dumps({"result": [
        {"mac": "02:00:00:00:00:0A", "ip": "10.0.0.9", "is_wired": True, "sw_mac": "02:11:00:00:00:01", "vlan": 10, "sw_port": 4, "secret": "x"},
        {"mac": "02:00:00:00:00:0B", "is_wired": False, "ap_mac": "02:11:00:00:00:02"}, {"ip": "10.0.0.1"},
    ]})
    df = s.clients_from_json(snap(("unifi", "site", "list active clients", body)))
    assert rows(df, "observation_type", "subj_id", "obj_id") == [
        ("arp_entry", "ip:10.0.0.9", "mac:02:00:00:00:00:0a"), ("mac_entry", "mac:02:00:00:00:00:0a", "device:02:11:00:00:00:01"),
        ("wlan_assoc", "mac:02:00:00:00:00:0b", "device:02:11:00:00:00:02"),
    ]
    raw = df.filter("observation_type = 'mac_entry'").first()
    assert "secret" not in raw["raw"] and raw["attrs"] == {"vlan": "10", "port": "4", "wired": "True"}


def test_devices_json_roles(snap):
    body = json.dumps([{"mac": "02:AA:00:00:00:01", "name": "core", "type": "usw", "ip": "192.0.2.1"}, {"mac": "02:AA:00:00:00:02", "model": "odd"}])
    df = s.devices_from_json(snap(("unifi", "site", "list devices", body)))
    assert sorted((x["attrs"]["name"], x["attrs"]["role"]) for x in df.collect()) == [("", "device"), ("core", "switch")]


def test_vms_and_nics(snap):
    listing = snap(("proxmox", "pve", "list vms", "[vm] web one (ID: 101)\n  - Status: running\n  - Node: pve3\n[vm] db (ID: 102)\n  - Node: pve4\n"))
    configs = snap(("proxmox", "pve3/101", "vm config", json.dumps({"net0": "virtio=BC:24:11:00:00:01,bridge=vmbr0,tag=20", "net1": "model=none", "cores": 2})))
    df = s.vms_from_snapshots(listing, configs)
    assert rows(df, "observation_type", "subj_id", "obj_id") == [
        ("vm_host", "device:pve3", "vm:pve3/101"), ("vm_host", "device:pve4", "vm:pve4/102"),
        ("vm_nic", "mac:bc:24:11:00:00:01", "device:pve3:vmbr0"),
    ]
    assert df.filter("observation_type = 'vm_nic'").first()["attrs"] == {
        "bridge": "vmbr0", "vlan": "20", "vmid": "101", "vm": "vm:pve3/101", "name": "web one",
    }


def test_truncated_payloads_are_dropped_and_counted(snap):
    df = snap(("juniper", "fw1", "show arp no-resolve", "02:00:00:00:00:01 10.0.0.1 ge0", True), ("juniper", "fw2", "show arp no-resolve", "02:00:00:00:00:02 10.0.0.2 ge0"))
    obs = s.observations_from_snapshots(df)
    assert rows(obs.filter("observation_type = 'arp_entry'"), "subj_id") == [("ip:10.0.0.2",)]
    assert rows(obs.filter("observation_type = 'device_inventory'"), "source_device") == [("fw2",)]
    assert rows(s.rejected(df), "device", "rejected") == [("fw1", 1)]


RULES = """
set security policies from-zone trust to-zone untrust policy web match source-address any
set security policies from-zone trust to-zone untrust policy web match destination-address srv
set security policies from-zone trust to-zone untrust policy web match application junos-https
set security policies from-zone trust to-zone untrust policy web then permit
set security policies from-zone trust to-zone untrust policy web then log session-init
inactive: set security policies from-zone trust to-zone untrust policy old match application any
set security policies from-zone trust to-zone untrust policy old then deny
set security policies global policy deny-all match from-zone dmz
set security policies global policy deny-all then reject
set security policies global policy timed scheduler-name night
set security policies global policy timed match vlan 7
set security policies global policy web then permit
junk line
"""


def test_rules_from_text(snap):
    got = {(x["rule_name"], tuple(x["from_zone"])): x for x in r.rules_from_text(snap(("juniper", "fw1", "x", RULES))).collect()}
    web = got[("web", ("trust",))]
    assert (web["action"], web["position"], web["enabled"], web["match_unknown"]) == ("allow", 0, True, False)
    assert web["source_addresses"] == ["any"] and web["dest_addresses"] == ["srv"] and web["service"] == ["junos-https"]
    old = got[("old", ("trust",))]
    assert (old["enabled"], old["action"], old["position"]) == (False, "deny", 1)
    deny = got[("deny-all", ("dmz",))]
    assert (deny["to_zone"], deny["action"], deny["position"]) == (["any"], "reject", 2)
    timed = got[("timed", ("any",))]
    assert timed["match_unknown"] and timed["unparsed_match"] == ["vlan"] and timed["scheduler_name"] == "night"
    # The same name in another scope is another rule.
    assert got[("web", ("any",))]["position"] == 4


XML_RULES = """<response><result><config><zone><entry name="z"/></zone><rulebase><security><rules>
<entry name="r1" uuid="u-1"><from><member>trust</member></from><to><member>any</member></to><source><member>any</member></source>
<destination><member>d1</member><member>d2</member></destination><application><member>ssl</member></application><service><member>any</member></service>
<action>allow</action><source-user><member>any</member></source-user><target><devices><entry name="x">a</entry></devices></target></entry>
<entry name="r2"><action>deny</action><disabled>yes</disabled><negate-source>yes</negate-source><source-hip><member>p</member></source-hip></entry>
<entry name=" "><action>deny</action></entry>
</rules></security></rulebase></config></result></response>"""


def test_rules_from_xml(snap):
    got = {x["rule_name"]: x for x in r.rules_from_xml(snap(("paloalto", "pan", "x", json.dumps({"result": XML_RULES})))).collect()}
    assert set(got) == {"r1", "r2"}
    assert got["r1"]["dest_addresses"] == ["d1", "d2"] and got["r1"]["uuid"] == "u-1" and not got["r1"]["match_unknown"]
    assert (got["r2"]["enabled"], got["r2"]["negate_source"], got["r2"]["match_unknown"], got["r2"]["position"]) == (False, True, True, 1)


def test_hit_counts_drop_ambiguous_names(snap):
    text = "Index From zone To zone Name Policy count Action\n1 trust untrust web 12 Permit\n2 dmz untrust dup 1 Permit\n3 trust dmz dup 9 Permit\n4 a b zero 0 Deny\n"
    assert rows(r.hit_counts_from_text(snap(("juniper", "fw1", "x", text))), "rule_name", "hit_count") == [("web", 12), ("zero", 0)]
    xml = "<r><vsys><entry name='vsys1'><rules><entry name='a'><hit-count>5</hit-count></entry><entry name='b'><x>1</x></entry><entry name=\"c\"><latest>yes</latest><hit-count> 7 </hit-count></entry></rules></entry></vsys></r>"
    assert rows(r.hit_counts_from_xml(snap(("paloalto", "pan", "x", xml))), "rule_name", "hit_count") == [("a", 5), ("c", 7)]


def test_attach_hit_counts_keeps_absent_absent(snap):
    rules = r.rules_from_text(snap(("juniper", "fw1", "x", RULES)))
    counts = r.hit_counts_from_text(snap(("juniper", "fw1", "x", "1 t u old 0 Deny")))
    got = rows(r.attach_hit_counts(rules, counts).filter("rule_name in ('old', 'timed')"), "rule_name", "hit_count")
    assert got == [("old", 0), ("timed", None)]


BOOK = """set security address-book global address A1 10.1.0.0/16
set security address-book global address A2 dns-name example.com
set security address-book global address A3 range-address 10.0.0.1 to 10.0.0.9
set security address-book global address A4 999.1.1.1
set security address-book global address A5 description words
set security address-book global address-set S1 address A1
set security address-book global address-set S1 address A2
set security zones security-zone trust address-book address T1 2001:db8::/32
set security address-book global attach zone dmz
set applications application web protocol tcp
set applications application web destination-port 443
set applications application multi term t1 protocol tcp
set applications application multi protocol udp
set applications application-set apps application web
set groups junos-defaults applications application junos-ssh protocol tcp
"""


def test_object_book_from_text_is_canonical_json(snap):
    row = r.object_books_from_text(snap(("juniper", "fw1", "x", BOOK))).first()
    expected = {
        "address_books": {
            "global": {
                "addresses": {
                    "A1": {"kind": "address", "value": "10.1.0.0/16"}, "A2": {"kind": "unknown", "reason": "dns-name"},
                    "A3": {"kind": "range", "low": "10.0.0.1", "high": "10.0.0.9"}, "A4": {"kind": "unknown", "reason": "unparsed"},
                },
                "address_sets": {"S1": {"members": ["A1", "A2"]}}, "attached_zones": ["dmz"],
            },
            "zone:trust": {"addresses": {"T1": {"kind": "address", "value": "2001:db8::/32"}}, "address_sets": {}, "attached_zones": []},
        },
        "applications": {"web": {"kind": "application", "protocol": "tcp", "destination_port": "443"}, "multi": {"kind": "unknown", "reason": "multi-term"}},
        "application_sets": {"apps": {"members": ["web"]}},
        "predefined_applications": {"junos-ssh": {"kind": "application", "protocol": "tcp"}}, "predefined_application_sets": {},
    }
    assert row["object_book"] == json.dumps(expected, sort_keys=True)


PARTS = {
    "address": '<address><entry name="a"><ip-netmask>10.0.0.1</ip-netmask></entry><entry name="b"><fqdn>x.y</fqdn></entry></address>',
    "address-group": '<address-group><entry name="g"><static><member>a</member></static></entry><entry name="d"><dynamic><filter>t</filter></dynamic></entry></address-group>',
    "service": '<service><entry name="s"><protocol><tcp><port>443</port></tcp></protocol></entry><entry name="q"/></service>',
    "service-group": '<service-group><entry name="sg"><members><member>s</member></members></entry></service-group>', "schedule": "<schedule/>",
}


def test_object_book_from_xml_and_whole_pass_rejection(snap):
    good = [("paloalto", "p1", k, v) for k, v in PARTS.items()]
    cut = [("paloalto", "p2", k, v, k == "service") for k, v in PARTS.items()]
    missing = [("paloalto", "p3", k, v) for k, v in PARTS.items() if k != "schedule"]
    broken = [("paloalto", "p4", k, v if k != "address" else "<address><entry></address>") for k, v in PARTS.items()]
    empty = [("paloalto", "p5", k, f"<{k}/>") for k in PARTS]
    got = {x["device_name"]: json.loads(x["object_book"]) for x in r.object_books_from_xml(snap(*good, *cut, *missing, *broken, *empty)).collect()}
    assert set(got) == {"p1", "p5"}
    assert got["p1"] == {
        "addresses": {"a": {"kind": "ip-netmask", "value": "10.0.0.1"}, "b": {"kind": "unknown", "reason": "fqdn"}},
        "address_groups": {"g": {"kind": "static", "members": ["a"]}, "d": {"kind": "unknown", "reason": "dynamic-address-group"}},
        "services": {"s": {"protocol": "tcp", "port": "443", "source_port": ""}, "q": {"kind": "unknown", "reason": "unrecognized-protocol"}},
        "service_groups": {"sg": {"members": ["s"]}}, "schedules": {},
    }


def test_gauges(snap):
    df = g.gauges_from_snapshots(snap(
        ("juniper", "fw1", "show chassis routing-engine", "Memory utilization 41 percent\n Idle 93 percent"),
        ("juniper", "fw1", "show chassis environment", "Class Item Status Measurement\nTemp Routing Engine OK 38 degrees C / 100 degrees F\nFans ok"),
        ("paloalto", "pan", "show system resources", "%Cpu(s): 5.0 us, 92.5 id\nMiB Mem : 8000.0 total, 100.0 free, 6000.0 used, 1 buff"),
        ("paloalto", "pan", "show system environmentals", "<r><entry><description>cpu</description><DegreesC>55.5</DegreesC></entry><entry><DegreesC>bad</DegreesC></entry></r>"),
        ("proxmox", "h", "list nodes", "[node] pve3\n - Status: ONLINE\n - Memory: 1/2 GB (50.5%)\n\n[node] pve4\n - Status: OFFLINE\n - Memory: 1 (9%)"),
        ("proxmox", "h", "list containers", "web (ID: 109)\n - Status: RUNNING\n - CPU: 120.0%\n - Memory: 1 (10%)"),
        ("unifi", "m", "device", json.dumps({"result": {"name": "sw", "system-stats": {"cpu": "12.5", "mem": None}, "temperatures": [{"name": "PHY", "value": 60}]}})),
    ))
    assert rows(df, "device", "scope", "metric_name", "sensor", "metric_value") == sorted([
        ("fw1", "device", "mem_util_pct", "", 41.0), ("fw1", "device", "cpu_util_pct", "", 7.0), ("fw1", "device", "temp_celsius", "Routing Engine", 38.0),
        ("pan", "device", "cpu_util_pct", "", 7.5), ("pan", "device", "mem_util_pct", "", 75.0), ("pan", "device", "temp_celsius", "cpu", 55.5),
        ("pve3", "node", "mem_util_pct", "", 50.5), ("web", "guest", "cpu_util_pct", "", 100.0), ("web", "guest", "mem_util_pct", "", 10.0),
        ("sw", "device", "cpu_util_pct", "", 12.5), ("sw", "device", "temp_celsius", "PHY", 60.0),
    ])


def test_alarms_dedupe_and_real_zero(snap):
    one = "1 alarms currently active\nAlarm time Class Description\n2026-06-05 11:00:00 UTC Minor Rescue configuration is not set"
    df = g.alarms(snap(
        ("juniper", "a", "show system alarms", one), ("juniper", "a", "show chassis alarms", one), ("juniper", "b", "show system alarms", "No alarms currently active"),
        ("juniper", "c", "show system alarms", "error: syntax error"),
    ))
    assert rows(df, "device", "metric_name", "sensor", "metric_value") == [
        ("a", "active_alarm_count", "", 1.0), ("a", "alarm", "minor", 1.0), ("b", "active_alarm_count", "", 0.0),
    ]


def test_lines_are_parsed_once_for_books(snap):
    from netfabric.sources import rulebases
    body = "set security address-book b address A 10.0.0.0/8\nset applications application web protocol tcp\n"
    plan = rulebases.object_books_from_text(snap(("juniper", "fw", "x", body)).repartition(1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
