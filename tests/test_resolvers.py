"""Topology, entity, policy and metric rules on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from netfabric import schemas
from netfabric.functions import ids
from netfabric.functions.siphash import siphash128, siphash128_batched
from netfabric.operators import audit as au
from netfabric.operators import entities as en
from netfabric.operators import graph as gr
from netfabric.operators import metrics as me
from netfabric.operators import policy as po
from netfabric.operators import scoring as sc
from netfabric.operators import topology as to
from netfabric.operators import upsert as up


def hash16(*parts):
    import hashlib
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


@pytest.fixture(scope="module")
def obs(spark, at):
    def make(*rows):
        data = [(at(f"2026-06-05 12:{r.get('m', 0):02d}:00"), r.get("c", "junos"), r.get("dev", "fw1"), "t_main", "l2", r["t"], "", r["s"], "", r.get("o", ""), r.get("a", {}), "") for r in rows]
        return spark.createDataFrame(data, schemas.OBSERVATIONS)
    return make


def test_newest_identifier_wins_in_any_input_order(obs):
    rows = [dict(t="arp_entry", s="ip:10.0.0.1", o="mac:02:00:00:00:00:01", m=1), dict(t="arp_entry", s="ip:10.0.0.9", o="mac:02:00:00:00:00:01", m=5)]
    for order in (rows, rows[::-1]):
        node = to.nodes_from_observations(obs(*order)).first()
        assert node["identifiers"] == {"mac": "02:00:00:00:00:01", "ip": "10.0.0.9"} and node["name"] == "02:00:00:00:00:01"


def test_inventory_fuses_mac_named_and_human_named_device(obs):
    o = obs(
        dict(t="mac_entry", s="mac:02:00:00:00:00:05", o="device:02:AA:00:00:00:01", c="unifi", a={"port": "3", "vlan": "10"}),
        dict(t="device_inventory", s="device:x", c="unifi", a={"name": "core", "mac": "02:AA:00:00:00:01", "role": "switch", "ip": "192.0.2.1"}, m=2),
        dict(t="device_inventory", s="device:y", c="junos", a={"name": "core-mgmt", "ip": "192.0.2.1", "role": "device"}, m=3),
        dict(t="device_inventory", s="device:z", c="junos", a={"name": "alone", "role": "firewall"}),
    )
    nodes, edges = to.nodes_from_observations(o), to.edges_from_observations(o)
    canonical = to.device_canonical_ids(nodes)
    assert canonical.count() == 3 and canonical.select("canonical_id").distinct().count() == 1
    merged = {r["name"]: r for r in to.merge_devices(nodes, canonical).filter("kind = 'device'").collect()}
    fused = next(r for n, r in merged.items() if n != "alone")
    assert len(merged) == 2 and fused["name"] in ("core", "core-mgmt")
    assert fused["identifiers"]["mac"] == "02:aa:00:00:00:01" and fused["identifiers"]["mgmt_ip"] == "192.0.2.1"
    edge = to.edge_confidence(to.remap_edges(edges, canonical)).first()
    assert edge["dst_id"] == fused["node_id"] and edge["confidence"] == 0.7 and edge["attrs"]["port"] == "3"


def test_lldp_seen_from_both_collectors_is_certain(obs):
    a = {"local_port": "p1", "remote_port": "q1", "remote_system": "sw", "remote_chassis": "02:BB:00:00:00:01"}
    o = obs(dict(t="lldp_neighbor", s="if:fw1:p1", o="if:sw:q1", a=a), dict(t="lldp_neighbor", s="if:fw1:p1", o="if:sw:q1", c="panos", a=a))
    edge = to.edge_confidence(to.edges_from_observations(o)).first()
    assert (edge["confidence"], edge["attrs"]["evidence"]) == (1.0, "junos:fw1,panos:fw1")
    sw = to.nodes_from_observations(o).filter("kind = 'device' and name = 'sw'").first()
    assert sw["identifiers"]["mac"] == "02:bb:00:00:00:01"


def test_merge_drops_self_loops(spark, at):
    t = at("2026-06-05 12:00:00")
    edges = spark.createDataFrame([("a", "b", "hosts", "virt", t, t, {}, ["x"])], "src_id string, dst_id string, edge_type string, layer string, first_seen timestamp, last_seen timestamp, attrs map<string,string>, evidence_set array<string>")
    canonical = spark.createDataFrame([("b", "a"), ("a", "a")], "node_id string, canonical_id string")
    assert to.remap_edges(edges, canonical).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)]
    star = [("hub", f"leaf{i}") for i in range(50)]
    df = spark.createDataFrame(chain + star, "src_id string, dst_id string")
    assert {(r["component"], r["count"]) for r in gr.connected_components(df).groupBy("component").count().collect()} == {("000", 61), ("hub", 51)}


def test_shortest_path_ties_take_the_smallest_path_from_either_side(spark):
    edges = spark.createDataFrame([("a", "m"), ("a", "k"), ("m", "z"), ("k", "z"), ("b", "z")], "src_id string, dst_id string")
    adj = gr.both_directions(edges)
    one = spark.createDataFrame([("a", "z"), ("a", "b"), ("a", "nowhere")], "src string, dst string")
    many = spark.createDataFrame([("a", "z"), ("b", "z"), ("m", "z")], "src string, dst string")
    assert {(r.src, r.dst): r.path for r in gr.shortest_paths(adj, one).collect()} == {("a", "z"): ["a", "k", "z"], ("a", "b"): ["a", "k", "z", "b"]}
    assert {r.src: r.path for r in gr.shortest_paths(adj, many).collect()} == {"a": ["a", "k", "z"], "b": ["b", "z"], "m": ["m", "z"]}


def test_reachability_ends_on_cycles_orphans_and_forks(spark):
    rows = [("c", f"{i}", f"{i - 1}" if i else "") for i in range(33)] + [("c", "f", "5"), ("c", "x", "y"), ("c", "y", "x"), ("c", "o", "gone"), ("d", "1", "")]
    got = gr.reaches_root(spark.createDataFrame(rows, "chain string, id string, parent string"))
    assert {(r.chain, r.id) for r in got.collect()} == {("c", str(i)) for i in range(33)} | {("c", "f"), ("d", "1")}


FLOW = "src_ip string, dst_ip string, observer_hostname string, bytes long, flows long, ports array<int>, rule_name string, provider string, transport string, first_seen timestamp, last_seen timestamp"


def test_assets_follow_segment_bindings(spark, at):
    t = at("2026-06-05 12:00:00")
    flows = spark.createDataFrame([
        ("10.0.0.1", "10.0.0.9", "fw1.lab", 10, 1, [443, 80], "r1", "juniper", "tcp", t, t),
        ("10.0.0.2", "10.0.0.9", "FW1", 5, 2, [443], "", "juniper", "udp", t, t),
        ("10.0.0.1", "10.0.0.9", "fw2", 1, 1, [22], "r1", "paloalto", "tcp", t, t),
    ], FLOW)
    raw = spark.createDataFrame([("fw1", "10.0.0.1", "02:AA", t, 1), ("fw1", "10.0.0.2", "02:aa", t, 1)], "source_device string, ip string, mac string, observed_at timestamp, mac_count int")
    addr = en.asset_addresses(flows, en.binding_map(raw))
    assets = {r["name"]: r for r in en.assets(addr).collect()}
    # Two addresses behind one MAC are one asset; the same address elsewhere is another.
    assert assets["02:aa"]["ip_count"] == 2 and assets["02:aa"]["confidence"] == 1.0
    assert assets["10.0.0.1"]["identity_basis"] == "ip_only" and assets["10.0.0.1"]["entity_id"] == hash16("t_main", "entity", "asset", "ip:fw2:10.0.0.1")
    resolved = en.flows_with_assets(flows, addr)
    edge = en.communication_attrs(en.communication_edges(resolved).filter("sessions = 3")).first()
    assert edge["attrs"] == {"sessions": "3", "bytes": "15", "ports": "443,80", "providers": "juniper", "transports": "tcp,udp", "observer_hosts": "FW1,fw1.lab"}
    assert en.governed_edges(resolved).count() == 2
    entity = en.assets_as_entities(en.assets(addr), addr).filter("name = '02:aa'").first()
    assert entity["identifiers"] == {"mac": "02:aa"}


@pytest.fixture(scope="module")
def gateway(spark, at):
    """A gateway with many addresses, two plain hosts, and the alias index of the three."""
    t = at("2026-06-05 12:00:00")
    rows = [("gw", "fw1", f"10.{k // 250}.{k % 250}.1", "02:01", False, t, t) for k in range(600)] + [
        ("a", "fw1", "10.9.9.9", None, False, t, t), ("b", "fw2", "10.9.9.9", None, False, t, at("2026-06-05 13:00:00"))]
    addresses = spark.createDataFrame(rows, "entity_id string, segment string, ip string, mac string, conflict boolean, first_seen timestamp, last_seen timestamp")
    entities = en.assets_as_entities(en.assets(addresses), addresses)
    return entities, en.store_alias_index(en.aliases(entities, addresses), 4)


def test_alias_index_finds_entities_by_id_mac_and_every_address(spark, gateway):
    entities, index = gateway
    ids = spark.createDataFrame([("gw",), ("02:01",), ("10.2.99.1",), ("10.9.9.9",), ("10.8.8.8",)], "lookup string")
    found = {(r.lookup, r.entity_id) for r in en.find_entities(entities, index, ids).collect()}
    assert found == {("gw", "gw"), ("02:01", "gw"), ("10.2.99.1", "gw"), ("10.9.9.9", "a"), ("10.9.9.9", "b")}
    best = {r.lookup: r.entity_id for r in en.find_entities(entities, index, ids, best_only=True).collect()}
    assert best["10.9.9.9"] == "b"
    assert en.entity_addresses(index, entities.select("entity_id")).groupBy("entity_id").count().filter("entity_id = 'gw'").first()["count"] == 600
    assert max(len(r.identifiers) for r in entities.collect()) == 1


def test_alias_index_is_read_without_a_shuffle(spark, gateway):
    _, index = gateway
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.range(1000).select(F.concat(F.lit("10.0."), F.col("id").cast("string"), F.lit(".1")).alias("alias"))
        plan = index.by_alias.join(ids, "alias")._jdf.queryExecution().executedPlan().toString()
        owned = index.by_entity.join(ids.withColumnRenamed("alias", "entity_id"), "entity_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # One exchange each, on the side of the ids.
    assert plan.count("Exchange hashpartitioning") == 1 and owned.count("Exchange hashpartitioning") == 1
    assert "SelectedBucketsCount: 4 out of 4" in plan


def test_binding_conflicts(spark, at):
    rows = [("fw1", "10.0.0.1", "02:01", at("2026-06-05 12:00:00"), 1), ("FW1.lab", "10.0.0.1", "02:02", at("2026-06-05 12:01:00"), 1), ("fw1", "10.0.0.2", "02:03", at("2026-06-05 12:00:00"), 2), ("fw1", "10.0.0.3", "02:04", at("2026-06-05 12:00:00"), 1), ("fw1", "", "x", at("2026-06-05 12:00:00"), 1)]
    got = {r.ip: (r.mac, r.conflict) for r in en.binding_map(spark.createDataFrame(rows, "source_device string, ip string, mac string, observed_at timestamp, mac_count int")).collect()}
    assert got == {"10.0.0.1": ("02:02", True), "10.0.0.2": ("02:03", True), "10.0.0.3": ("02:04", False)}


@pytest.mark.parametrize("covered,sessions,hits,age,status", [
    (True, 5, 9, 1, "used"), (True, 0, 0, 1, "unused"), (True, 5, 0, 1, "unknown"), (True, 0, 7, 1, "unknown"),
    (True, 0, None, 1, "unknown"), (True, 0, 0, 30, "unknown"), (True, 0, 0, None, "unknown"), (False, 0, 0, 1, "unknown"),
])
def test_unused_verdicts(spark, at, covered, sessions, hits, age, status):
    as_of = "2026-06-08 00:00:00"
    policies = spark.createDataFrame([("fw1", "r", hits, None if age is None else at(f"2026-06-0{6 if age > 24 else 7} 20:00:00"))], "device_name string, rule_name string, hit_count long, hit_count_collected_at timestamp")
    buckets = [("fw1.lab", "other", at("2026-06-01 00:00:00"), 1)] + ([("fw1", "other", at("2026-06-07 23:00:00"), 1)] if covered else []) + ([("fw1", "r (global)", at("2026-06-03 00:00:00"), sessions)] if sessions else [])
    usage = spark.createDataFrame(buckets, "observer_hostname string, rule_name string, bucket_start timestamp, sessions long")
    row = po.unused_rules(policies, usage, as_of).first()
    assert row["status"] == status and row["device_hit_count"] == hits


def test_minted_surrogates_reuse_lengthen_and_follow_the_key_version(spark, at):
    t = at("2026-06-05 12:00:00")
    values = spark.createDataFrame([(f"10.0.{i // 250}.{i % 250}",) for i in range(600)], "real_value string")
    known = spark.createDataFrame([("host", "10.0.0.1", "h_old", 1, t, t), ("host", "10.0.0.2", "h_v0", 0, t, t)], schemas.PSEUDONYMS)
    got = me.mint_surrogates(values, known, "host", b"k", 1, "2026-06-05", base_length=2)
    rows = {r.real_value: r.surrogate for r in got.collect()}
    assert len(rows) == 600 and len(set(rows.values())) == 600
    assert rows["10.0.0.1"] == "h_old" and rows["10.0.0.2"] != "h_v0"


def test_public_outputs_hold_only_allowed_columns(spark, at):
    t = at("2026-06-05 12:00:00")
    nodes = spark.createDataFrame([("n1", "t_main", "device", "secret", {"mac": "m"}, t, t, {})], "node_id string, tenant_id string, kind string, name string, identifiers map<string,string>, first_seen timestamp, last_seen timestamp, attrs map<string,string>")
    assert me.public_nodes(nodes, (1, 2)).columns == ["node_id", "tenant_id", "kind", "first_seen", "last_seen"]
    edges = spark.createDataFrame([("e", "n1", "n2", t)], "edge_id string, src_id string, dst_id string, last_seen timestamp")
    allow = spark.createDataFrame([("secret", "primary", True)], "name string, site string, ollama boolean")
    snap = me.public_topology_snapshot(nodes, edges, allow, "2026-06-05 12:30:00", "salt")
    assert snap["nodes"].columns == ["id", "reachable", "ollama", "site"] and tuple(snap["nodes"].first()) == ("n1", True, True, "primary")
    assert snap["edges"].columns == ["source", "target", "remote", "recent_activity"] and tuple(snap["summary"].first()) == (1, 0, False)


def _calls(spark, at, n, server="s1"):
    rows = [(at(f"2026-06-05 12:{i // 60:02d}:{i % 60:02d}"), "p", "evidence", "tool", f'{{"server_id": "{server}"}}', ["c"], "allow", i, "", "", "", "") for i in range(n)]
    return spark.createDataFrame(rows, "ts timestamp, principal string, tier string, tool string, args string, data_classes array<string>, decision string, row_count long, error string, client_name string, model_id string, actor_type string")


def test_rows_that_the_order_leaves_equal_are_refused(spark, at):
    none = spark.createDataFrame([], "tier string, server_id string, row_hash string")
    calls = _calls(spark, at, 6)
    with pytest.raises(ValueError, match="equal"):
        au.append_chained(calls.withColumn("ts", F.lit("2026-06-05 12:00:00").cast("timestamp")), none)


def test_chain_in_blocks_equals_one_block_and_verifies_clean(spark, at):
    calls = _calls(spark, at, 50).unionByName(_calls(spark, at, 3, "s2"))
    none = spark.createDataFrame([], "tier string, server_id string, row_hash string")
    whole = {(r.server_id, r.ts): r.row_hash for r in au.append_chained(calls, none).collect()}
    blocks = au.append_chained(calls, none, block_rows=7)
    assert {(r.server_id, r.ts): r.row_hash for r in blocks.collect()} == whole
    assert au.verify_chain(blocks).count() == 0
    tails = au.chain_tails(au.with_chain_key(blocks))
    more = au.append_chained(calls.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")), tails)
    both = blocks.unionByName(more.select(blocks.columns))
    assert au.verify_chain(both).count() == 0 and au.chain_tails(au.with_chain_key(both)).count() == 2


def test_verification_goes_on_from_verified_blocks(spark, at, tmp_path):
    none = spark.createDataFrame([], "tier string, server_id string, row_hash string")
    calls = _calls(spark, at, 12).withColumn("ts", F.col("ts") + F.make_interval(days=(F.col("row_count") % 4).cast("int")))
    chain = au.append_chained(calls, none).select(*[c for c in calls.columns], "prev_hash", "row_hash").persist()
    state, seen = str(tmp_path / "verified"), lambda df: sorted(tuple(r) for r in df.collect())
    left = lambda df: {r.day for r in au.unverified_blocks(au.block_digests(df, "k"), state).collect()}
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "verified").rglob("*.parquet")}
    days = {f"2026-06-{d:02d}" for d in (5, 6, 7, 8)}
    assert left(chain) == days and seen(au.verify_chain_onward(chain, state, "k")) == [] and left(chain) == set()
    before = files()
    assert seen(au.verify_chain_onward(chain, state, "k")) == [] and files() == before  # nothing was hashed again
    edit = chain.withColumn("tool", F.when(F.col("row_count") == 1, "x").otherwise(F.col("tool")))
    assert left(edit) == {"2026-06-06"}
    assert seen(au.verify_chain_onward(edit, state, "k")) == seen(au.verify_chain(edit)) != []
    assert {f for f in files() if f not in before and "day=2026-06-06" not in f} == set() and before.items() <= files().items()
    for other in (chain.filter("row_count % 4 <> 3").unionByName(chain.filter("row_count = 5")),
                  chain.withColumn("data_classes", F.when(F.col("row_count") != 6, F.col("data_classes")))):
        assert seen(au.verify_chain_onward(other, state, "k")) == seen(au.verify_chain(other))
    assert au.verify_chain_onward(chain.filter("false"), str(tmp_path / "none"), "k").count() == 0


def test_tampering_is_found(spark, at):
    none = spark.createDataFrame([], "tier string, server_id string, row_hash string")
    chain = au.append_chained(_calls(spark, at, 6), none)
    kinds = lambda df: {(r.type) for r in au.verify_chain(df).collect()}
    assert kinds(chain.withColumn("tool", F.when(F.col("row_count") == 2, "x").otherwise(F.col("tool")))) == {"content_edit"}
    assert kinds(chain.filter("row_count <> 2")) == {"missing_predecessor", "unreachable", "fork"}
    assert kinds(chain.unionByName(chain.filter("row_count = 5"))) == {"duplicate_row"}
    assert kinds(chain.withColumn("args", F.lit('{"server_id": 7}'))) >= {"unidentified_writer", "content_edit"}


def test_trailing_window_is_half_open_and_split_by_buckets(spark, at):
    times = ["12:00:00", "12:00:59", "12:01:00", "12:01:30"]
    df = spark.createDataFrame([("p", at(f"2026-06-05 {t}")) for t in times], "principal string, ts timestamp")
    got = au.calls_in_trailing_window(df, 60, 2).orderBy("ts").collect()
    # A call exactly one window ago no longer counts.
    assert [(r.calls_in_window, r.breach) for r in got] == [(1, False), (2, False), (2, False), (3, True)]


def test_scoring_fails_closed(spark):
    q = spark.createDataFrame([("a", "sovereign", "c", "d", [], "refusal", None, None, None, None, None), ("b", "public", "c", "e", ["top_series"], "reference", "exact", None, None, None, None)],
                              "id string, tier string, category string, difficulty string, required_tools array<string>, ptype string, match string, min_overlap int, tolerance double, tolerance_pct double, expected string")
    answers = spark.createDataFrame([("b", "{}", ["1", "2"], None, None)], "id string, answer string, values array<string>, number double, error string")
    refs = spark.createDataFrame([("b", "2"), ("b", "1")], "id string, value string")
    tools = spark.createDataFrame([("b", ["top_series", "run_sql"])], "id string, tools array<string>")
    got = {r.id: (r["pass"], list(r.reasons)) for r in sc.score(q, answers, refs, tools).collect()}
    assert got == {"a": (False, ["question not in answers"]), "b": (False, ["tools: non-public tools observed on public run"])}
    assert sc.score(q, answers, refs, tools.withColumn("tools", F.array(F.lit("top_series")))).filter("pass").count() == 1


def test_versions_and_evidence_rules(spark, at):
    hist = spark.createDataFrame([("k", "h1", at("2026-06-01 00:00:00")), ("k", "h2", at("2026-06-02 00:00:00"))], "rule string, content_hash string, valid_from timestamp")
    new = lambda h: spark.createDataFrame([("k", h, at("2026-06-03 00:00:00")), ("new", "h", at("2026-06-03 00:00:00"))], "rule string, content_hash string, valid_from timestamp")
    assert {r.rule for r in up.append_changed_versions(new("h2"), hist, ["rule"]).collect()} == {"new"}
    # Going back to an older content is a change too.
    assert {r.rule for r in up.append_changed_versions(new("h1"), hist, ["rule"]).collect()} == {"k", "new"}
    seg = spark.createDataFrame([("s", "r", i) for i in range(3)], "server_id string, run_id string, segment_seq long")
    assert up.ingest_evidence(seg, seg.filter("false")).count() == 3
    assert up.ingest_evidence(seg, seg.filter("segment_seq = 0")).count() == 2


def test_results_do_not_depend_on_partitioning(spark):
    from netfabric.plans.queries import load_all
    q, sf = load_all().queries, "/root/testdata/sf0.001"
    for name in ("communication_edges", "unused_rules", "nodes_from_observations"):
        seen = []
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(sorted(map(str, q[name](spark, sf).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert seen[0] == seen[1]


def _siphash_by_force(data, key):
    mask = (1 << 64) - 1
    rotl = lambda x, b: (x << b | x >> (64 - b)) & mask
    v = [0x736F6D6570736575 ^ key[0], 0x646F72616E646F6D ^ key[1], 0x6C7967656E657261 ^ key[0], 0x7465646279746573 ^ key[1]]

    def turn():
        v[0] = (v[0] + v[1]) & mask; v[1] = rotl(v[1], 13) ^ v[0]; v[0] = rotl(v[0], 32)  # noqa: E702
        v[2] = (v[2] + v[3]) & mask; v[3] = rotl(v[3], 16) ^ v[2]  # noqa: E702
        v[0] = (v[0] + v[3]) & mask; v[3] = rotl(v[3], 21) ^ v[0]  # noqa: E702
        v[2] = (v[2] + v[1]) & mask; v[1] = rotl(v[1], 17) ^ v[2]; v[2] = rotl(v[2], 32)  # noqa: E702

    padded = data + bytes(7 - len(data) % 8) + bytes([len(data) % 256])
    for k in range(0, len(padded), 8):
        word = int.from_bytes(padded[k : k + 8], "little")
        v[3] ^= word
        turn()
        turn()
        v[0] ^= word
    v[2] ^= 0xFF
    for _ in range(4):
        turn()
    return v[0] ^ v[1], v[2] ^ v[3]


def test_keyed_hash_equals_the_published_vectors_and_a_plain_loop(spark):
    key = tuple(int.from_bytes(bytes(range(k, k + 8)), "little") for k in (0, 8))
    # Published SipHash-2-4 values of the bytes 0, 1, 2 ... of each length under this key.
    published = {0: 0x726FDB47DD0E0E31, 1: 0x74F839C593DC67FD, 2: 0x0D6C8009D9A94F5A, 3: 0x85676696D7FB7E2D, 4: 0xCF2794E0277187B7,
                 5: 0x18765564CD99A68D, 6: 0xCBC9466E58FEE3CE, 7: 0xAB0200F58B01D137, 8: 0x93F5F5799A932462, 15: 0xA129CA6149BE45E5}
    texts = ["".join(map(chr, range(n))) for n in published] + ["0123456789abcdef", "é" * 9, "x" * 300, None]
    rows = spark.createDataFrame([(t,) for t in texts], "id string").select("id", siphash128("id", key).alias("h"))
    found = {r.id: r.h for r in rows.collect()}
    assert found.pop(None) is None and len(found) == len(texts) - 1
    for text, digits in found.items():
        low, high = (int.from_bytes(bytes.fromhex(digits[k : k + 16]), "little") for k in (0, 16))
        assert (low, high) == _siphash_by_force(text.encode(), key) and digits == digits.upper()
        if text in texts[: len(published)]:
            assert low ^ high == published[len(text)]
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_keyed_hash_of_batches_equals_the_column_expression(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (0, 1, 7, 8, 9, 15, 16, 40, 300)] + [("é" * 9,), (None,)], "id string")
    hashed = rows.select(siphash128("id", (1, 2**63 + 5)).alias("a"), siphash128_batched("id", (1, 2**63 + 5)).alias("b")).collect()
    assert all(r.a == r.b for r in hashed) and sum(r.a is None for r in hashed) == 1


@pytest.mark.parametrize("window", [1, 3, 20, 1000])
def test_blocks_in_a_window_equal_a_walk(spark, window):
    import random
    rng = random.Random(window)
    tokens = [rng.choice("abcdefghijklmnop"[: rng.choice([2, 5, 16])]) for _ in range(160)] + ["hot"] * 30
    kept, want = [], []
    for k, token in enumerate(tokens):
        if token not in kept[-window:]:
            kept.append(token)
            want.append(k)
    rows = spark.createDataFrame(list(enumerate(tokens)), "received_at long, token string")
    assert sorted(r.received_at for r in up.dedup_in_window(rows, window=window).collect()) == want


def test_dyadic_cover_is_exact_and_small(spark):
    import random
    rng = random.Random(7)
    spans = [(a, a + rng.randint(0, 300)) for a in (rng.randint(0, 2000) for _ in range(200))] + [(0, 0), (1_700_000_000, 1_700_000_000 + 308_000_000)]
    df = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", au.dyadic_cover(F.col("lo"), F.col("hi")).alias("c"))
    for r in df.collect():
        pieces = sorted((p["index"] << p["level"], (p["index"] + 1) << p["level"]) for p in r.c)
        assert pieces[0][0] == r.lo and pieces[-1][1] == r.hi + 1 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
        # The last span is ten years in units of 1024 ms.
        assert len(pieces) < 60


def _path_by_force(edges, src, dst):
    around = {}
    for a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    level, seen = {src: [src]}, {src}
    while level:
        if dst in level:
            return level[dst]
        found = {}
        for node, path in level.items():
            for other in around.get(node, ()):
                if other not in seen and (other not in found or [*path, other] < found[other]):
                    found[other] = [*path, other]
        seen |= set(found)
        level = found
    return None


def test_paths_searched_from_both_ends_equal_brute_force(spark):
    import random
    rng = random.Random(3)
    nodes = [f"n{k:02d}" for k in range(40)]
    edges = [tuple(rng.sample(nodes[:34], 2)) for _ in range(44)] + [(nodes[34], nodes[35])] + [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(11)]
    pairs = [(a, b) for a in nodes[::3] for b in nodes[::4]] + [("c00", "c11"), ("c10", "c02"), ("c00", "n00"), ("gone", "n01"), ("n34", "n35")]
    adj = gr.both_directions(spark.createDataFrame(edges, "src_id string, dst_id string"))
    got = {(r.src, r.dst): r.path for r in gr.shortest_paths(adj, spark.createDataFrame(pairs, "src string, dst string")).collect()}
    want = {(a, b): _path_by_force(edges, a, b) for a, b in pairs}
    assert got == {k: p for k, p in want.items() if p is not None}
    reach = {(r.start, r.node): r.hops for r in gr.within_depth(adj, spark.createDataFrame([("n00",), ("c05",)], "start string"), 3).collect()}
    near = {(a, b): len(p) - 1 for a in ("n00", "c05") for b in {x for e in edges for x in e} if (p := _path_by_force(edges, a, b)) and len(p) <= 4}
    assert reach == near


@pytest.fixture(scope="module")
def star(spark, at):
    """Nodes and edges of two switches with 60 servers and hosts each, a chain between them, and a node without edges."""
    pairs = [(f"{kind}{k:02d}", f"sw{k % 2}") for k in range(60) for kind in ("srv", "host")] + [("sw0", "core"), ("core", "sw1"), ("core", "core")]
    names = sorted({x for p in pairs for x in p}) + ["lone"]
    nodes = spark.createDataFrame([(n, n, {"name": n}, at("2026-06-05 11:00:00")) for n in names], "node_id string, name string, identifiers map<string,string>, last_seen timestamp")
    edges = spark.createDataFrame([(f"{a}-{b}", a, b, "l2", at("2026-06-05 11:00:00")) for a, b in pairs], "edge_id string, src_id string, dst_id string, layer string, last_seen timestamp")
    return pairs, names, nodes, edges


def _balls(pairs, starts, depth):
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    out = {}
    for s in starts:
        hops = {s: 0}
        for k in range(depth):
            for n in [n for n, h in hops.items() if h == k]:
                for m in around.get(n, ()):
                    hops.setdefault(m, k + 1)
        out |= {(s, n): h for n, h in hops.items()}
    return out


def _counted(monkeypatch):
    written = []

    def cut(df, *args):
        from netfabric.session import cut_lineage
        out = cut_lineage(df, *args)
        written.append(out.count())
        return out

    for module in (gr, to):
        monkeypatch.setattr(module, "cut_lineage", cut, raising=False)
    return written


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_edges_in_reach_are_whole_and_never_written_by_lookup(spark, star, monkeypatch, depth):
    pairs, names, nodes, edges = star
    written = _counted(monkeypatch)
    starts = [n for n in names if n.startswith("srv")] + ["lone", "core"]
    _, got = to.neighbors(nodes, edges, spark.createDataFrame([(s,) for s in starts], "lookup string"), "2026-06-05 12:00:00", depth=depth, layer="l2")
    balls = _balls(pairs, starts, depth)
    want = sorted((s, f"{a}-{b}") for s in starts for a, b in pairs if (s, a) in balls and (s, b) in balls)
    assert sorted((r.lookup, r.edge_id) for r in got.collect()) == want
    assert max(written) < 600  # 60 lookups with 60 nodes each in reach are 3,600


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_nodes_in_reach_are_whole_and_never_written_by_lookup(spark, star, monkeypatch, depth):
    pairs, names, nodes, edges = star
    written = _counted(monkeypatch)
    starts = [n for n in names if n.startswith("srv")] + ["lone", "core"]
    got, _ = to.neighbors(nodes, edges, spark.createDataFrame([(s,) for s in starts], "lookup string"), "2026-06-05 12:00:00", depth=depth)
    rows = [(r.lookup, r.node_id, r.hops) for r in got.collect()]
    assert sorted(rows) == sorted((s, n, h) for (s, n), h in _balls(pairs, starts, depth).items())
    assert max(written) < 600


def test_nodes_in_reach_are_shuffled_once_where_they_go_out(spark, star, tmp_path):
    pairs, names, nodes, edges = star
    nodes.write.parquet(str(tmp_path / "nodes"))
    stored = spark.read.parquet(str(tmp_path / "nodes"))
    starts = [n for n in names if n.startswith("srv")] + ["lone"]
    got, _ = to.neighbors(stored, edges, spark.createDataFrame([(s,) for s in starts], "lookup string"), "2026-06-05 12:00:00", depth=2)
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert physical.count("FileScan parquet [node_id#") == 1  # counting their blocks reads classes only
    assert physical.count("Exchange hashpartitioning(class") == 2  # the blocks of either side, and nothing before them


def test_a_loop_on_a_node_without_other_edges_is_in_its_reach(spark, at):
    when = at("2026-06-05 11:00:00")
    nodes = spark.createDataFrame([(n, {"name": n}, when) for n in ("x", "y", "a")], "node_id string, identifiers map<string,string>, last_seen timestamp")
    edges = spark.createDataFrame([(i, s, d, "l2", when) for i, s, d in [("xx", "x", "x"), ("yy", "y", "y"), ("xn", "x", None), ("nn", None, None), ("ab", "a", "b")]],
        "edge_id string, src_id string, dst_id string, layer string, last_seen timestamp")
    for depth in (1, 2):
        reach, inside = to.neighbors(nodes, edges, spark.createDataFrame([("x",), ("a",)], "lookup string"), "2026-06-05 12:00:00", depth=depth)
        assert sorted((r.lookup, r.node_id, r.hops) for r in reach.collect()) == [("a", "a", 0), ("x", "x", 0)]
        assert sorted((r.lookup, r.edge_id) for r in inside.collect()) == [("a", "ab"), ("x", "xx")]


def test_block_join_equals_a_plain_join(spark, monkeypatch):
    from netfabric.functions import skew
    monkeypatch.setattr(skew, "LEFT_BLOCK", 7)
    monkeypatch.setattr(skew, "RIGHT_BLOCK", 3)
    left = spark.createDataFrame([(k % 3 or None, k // 2) for k in range(60)], "key int, a int")
    right = spark.createDataFrame([(k % 4 or None, k // 3) for k in range(40)], "key int, b int")
    rows = lambda df: sorted(map(tuple, df.select("key", "a", "b").collect()))
    assert rows(skew.block_join(left, right, "key")) == rows(left.join(right, "key"))


def test_all_alerts_are_counted_and_listed_without_a_shuffle_of_their_rows(spark, at):
    from netfabric.operators import flows as fl
    when = at("2026-06-05 11:00:00")
    rows = [(f"e{k}", f"a{k % 3}", f"b{k % 4}" if k % 5 else None) for k in range(40)] + [("e1", "a1", "b1"), ("e2", "a0", "b3"), (None, "a1", "b1"), (None, "a2", None)]
    events = spark.createDataFrame([(i, when, s, d, "unifi", "alert", {}) for i, s, d in rows],
        "event_id string, timestamp timestamp, source_ip string, destination_ip string, event_provider string, event_kind string, ext map<string,string>")
    asked = {"p": {"a0", "b1"}, "q": {"a1"}, "r": {"b3", "a2"}, "s": {"zz"}}
    ips = spark.createDataFrame([(k, ip) for k, v in asked.items() for ip in sorted(v)], "k string, ip string")
    want = {k: {i for i, s, d in rows if s in v or d in v} for k, v in asked.items()}
    got = fl.alerts_for_ips(events, ips, "2026-06-05 12:00:00", keys=["k"])
    found = [(r.k, r.event_id) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == {(k, i) for k, v in want.items() for i in v}
    counts = fl.alert_counts_for_ips(events, ips, "2026-06-05 12:00:00", keys=["k"])
    assert {r.k: r.detections for r in counts.collect()} == {k: len(v) for k, v in want.items() if v}


def test_components_that_grow_equal_a_full_run_after_every_batch(spark):
    import random
    rng = random.Random(11)
    edges = [(f"n{rng.randint(0, 60):02d}", f"n{rng.randint(0, 60):02d}") for _ in range(44)]
    known, seen = gr.empty_components(spark, 8), []
    for k in range(0, len(edges), 11):
        batch = edges[k : k + 11]
        seen += batch
        known = gr.add_edges(known, spark.createDataFrame(batch, "src_id string, dst_id string"))
        got = {r.id: r.component for r in gr.component_labels(known).collect()}
        full = {r.id: r.component for r in gr.connected_components(spark.createDataFrame(seen, "src_id string, dst_id string")).collect()}
        # A node with nothing but a loop is its own component here and has no row there.
        assert got == {x: x for e in seen for x in e} | full
    assert gr.component_labels(known).count() == len(got)


def test_merged_sketches_estimate_distinct_connections(spark, at):
    n, t = 100_000, at("2026-06-05 12:00:00")
    flows = spark.range(2 * n).select(
        F.lit("t_main").alias("tenant_id"), F.lit("flow_end").alias("event_action"), (F.lit(t) + F.expr("make_interval(0, 0, 0, 0, 0, cast(id % 50 as int))")).alias("timestamp"),
        *[F.concat(F.lit(c), (F.col("id") % n).cast("string")).alias(c) for c in me.CONNECTION_TUPLE], F.lit(1).cast("long").alias("network_bytes"))
    fine = me.connection_sketches(flows, "2026-06-06 00:00:00", since="2026-06-05 00:00:00", bucket_seconds=300)
    assert fine.count() == 10
    day = me.sketch_series(me.roll_up_sketches(fine, 86_400)).collect()
    assert len(day) == 1 and abs(day[0]["value"] - n) <= 0.03 * n
    whole = me.sketch_series(me.connection_sketches(flows, "2026-06-06 00:00:00", since="2026-06-05 00:00:00", bucket_seconds=86_400)).first()
    assert abs(whole["value"] - day[0]["value"]) <= 0.01 * n
