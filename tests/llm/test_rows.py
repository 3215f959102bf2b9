"""Mixing, sharding, vectors, WARC, tool calls and the pipeline against brute force, and on odd rows."""

import gzip
import importlib.util
import json
import pathlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netfabric.llm import closepairs, langid, mixing, queries, rangejoin, sharding, toolcalls, warc
from netfabric.session import _checkpoint_root


# Mixing

def targets_by_hand(sizes, weights=(1, 2, 3), cap=3):
    """Pour out the total by weight, again and again, into sources that are not full."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-6 and free:
        total = sum(w[s] for s in free)
        share = {s: left * w[s] / total for s in free}
        left = 0.0
        for s, x in share.items():
            room = cap * sizes[s] - target[s]
            target[s] += min(x, room)
            left += max(0.0, x - room)
            if x >= room:
                free.discard(s)
    return target


def check_mix(docs):
    rows = mixing.mix_sources(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for s, t in targets_by_hand(sizes).items():
        assert target[s] == pytest.approx(t, rel=1e-9, abs=1e-6)
        largest = max(r.size for r in rows if source[r.doc_id] == s)
        assert abs(taken[s] - t) <= largest / 2 + 1e-6
    return rows


def test_mix_meets_targets_and_reruns_agree(small, odd_docs):
    docs = small("documents").withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")))
    assert sorted(check_mix(docs)) == sorted(mixing.mix_sources(docs.repartition(7)).collect())
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert all(r.size == words[r.doc_id] for r in mixing.mix_sources(docs).collect())


def test_budgets_nest(small):
    docs = small("documents").select("doc_id", "text", "source")
    rows = mixing.sized(docs, "doc_id", "text", "source")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    taken = []
    for share in (0.2, 0.5, 0.9):
        plan = mixing.draw_thresholds(rows, sizes.withColumn("target", F.col("source_size") * share))
        taken.append({r.doc_id for r in rows.join(plan, "source").filter("hash < threshold").collect()})
    assert taken[0] < taken[1] < taken[2]


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = mixing.mix_sources(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0
    copies = Counter((r.doc_id, r.size) for r in rows for _ in range(r.copies))
    mixed = mixing.mixed_rows(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert Counter((r.doc_id, len((r.text or "").encode().split())) for r in mixed.collect()) == copies


# Sharding

def shards_by_hand(rows, shards):
    from hashlib import md5
    order = sorted(((md5((t or "").encode()).hexdigest()[:16], f"{i:016X}", i, len((t or "").encode()) + 8) for i, t in rows))
    total, seen, out = sum(x[3] for x in order), 0, {}
    groups = defaultdict(int)
    for key, _, _, n in order:
        groups[key] += n
    starts = {}
    for key, _, i, n in order:
        starts.setdefault(key, seen)
        whole = groups[key] * 50 * shards <= total
        twice = 2 * starts[key] + groups[key] if whole else 2 * seen + n
        out[i] = min(shards - 1, twice * shards // (2 * total))
        seen += n
    slots, at = Counter(), {}
    for _, _, i, _ in order:
        at[i] = slots[out[i]]
        slots[out[i]] += 1
    return {i: (out[i], at[i]) for i in out}


@pytest.mark.parametrize("hot", [False, True])
def test_shards_equal_brute_force(spark, small, hot):
    docs = small("documents").select("doc_id", "text")
    if hot:  # A third of the rows have one text, which overfills its range.
        docs = docs.unionByName(spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.lit("one text that many share " * 40).alias("text")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sharding.shard_by_bytes(docs, shards=6).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == shards_by_hand(rows, 6)
    text = dict(rows)
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" for r in got)
    filled = Counter()
    for r in got:
        filled[r.shard] += r.size
    mean = sum(filled.values()) / 6
    largest = max(r.size for r in got)
    assert all(abs(x - mean) <= largest + mean / 25 for x in filled.values())
    if not hot:
        together = defaultdict(set)
        for r in got:
            together[text[r.doc_id]].add(r.shard)
        assert all(len(s) == 1 for t, s in together.items() if sum(x == t for x in text.values()) * len(t) < mean / 60)


def test_overfull_ranges_are_divided(spark):
    rows = spark.range(3000).select(F.lpad(F.hex("id"), 16, "0").alias("key"), F.lit(100).cast("long").alias("size"))
    assert len(sharding.range_sizes(rows, sharding.draw_splitters(rows, F.col("key"), 20, 1))) > 10
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the very same text").alias("text"))
    got = Counter(r.shard for r in sharding.shard_by_bytes(docs, shards=10).collect())
    assert max(got.values()) - min(got.values()) <= 1 and len(got) == 10


def test_shards_of_odd_rows(odd_docs, no_docs):
    got = sharding.shard_by_bytes(odd_docs, shards=4).collect()
    assert len(got) == odd_docs.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sorted(str(r.text_crc32) for r in got if r.size == 8) == ["0", "None", "None"]
    assert sharding.shard_by_bytes(no_docs).count() == 0


# Vectors

def links_by_hand(rows, cosine=0.98):
    good = {}
    for i, v, label in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and label is not None:
            good[i] = (label, np.array(v, float))
    links, at = Counter(), {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(good)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            (la, x), (lb, y) = good[a], good[b]
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                at[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in at}


@pytest.mark.parametrize("cell_rows", [2000, 60, 15])
def test_links_equal_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(rangejoin, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(420):
        spread = 0.12 if i % 3 else 0.4
        rows.append((i, [float(x) for x in centres[i % 12] + spread * rng.normal(size=8)], int(i % 2)))
    rows += [(1000 + i, rows[0][1], 0) for i in range(90)]  # a group of exact copies
    rows += [(2000 + i, [float(x * 3.0) for x in rows[1][1]], 1) for i in range(5)]  # the same direction, longer
    got = rangejoin.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == links_by_hand(rows)


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
            (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1e-30, 0.0], 1), (12, [1e30, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("cell", F.lit(1))
    got = rangejoin.link_vectors(vectors).collect()
    assert len(got) == len(rows)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert found[None] == (0, None, False)
    assert [found[i][:2] for i in (1, 2, 11, 12)] == [(3, 1)] * 4 and [found[i][2] for i in (1, 2, 11, 12)] == [True, False, False, False]
    assert all(found[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert rangejoin.link_vectors(vectors.filter("false")).count() == 0


def test_an_id_with_several_vectors_keeps_the_links_of_each(spark):
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [2.0, 0.01], 1), (3, [0.01, 1.0], 1), (1, [1.0, 0.0], 1), (4, [-1.0, 0.0], 1), (0, [1.0, 0.0], 2)],
        "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in rangejoin.link_vectors(vectors).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def _directions(rng, n, dim=64):
    v = rng.normal(size=(n, dim))
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


@pytest.mark.parametrize("leaf,few", [(512, 1 << 18), (12, 1)])
@pytest.mark.parametrize("dim", [1, 3, 40, 64])
def test_pairs_of_codes_are_all_close_vectors_once(monkeypatch, leaf, few, dim):
    monkeypatch.setattr(closepairs, "LEAF", leaf)
    monkeypatch.setattr(closepairs, "FEW", few)
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(500, dim))
    v[250:] = v[:250] + 0.15 * rng.normal(size=(250, dim))
    v[:30] = np.eye(dim)[np.arange(30) % dim]
    if dim == 64:  # The transform turns these into one component, which is cut off.
        signs = np.random.default_rng(dim).choice([-1.0, 1.0], dim)
        v[30:60] = signs + 0.1 * rng.normal(size=(30, dim))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    codes, moved = closepairs.codes_of(v)
    assert dim < 64 or (moved > closepairs.usual_error(64)).sum() >= 30
    for radius in (0.05, 0.2, 1.0):
        for x, y in ((slice(0, 500), None), (slice(0, 300), slice(200, 500))):
            other = x if y is None else y
            args = (codes[x], moved[x], *((None, None) if y is None else (codes[y], moved[y])))
            got = [(min(a, b), max(a, b), c) if y is None else (a, b, c) for h, g, sure, _ in closepairs.within(*args, radius)
                   for a, b, c in zip(h.tolist(), g.tolist(), sure.tolist(), strict=True)]
            true = {(a, b) for a, b in np.argwhere(np.sqrt(np.maximum(0, 2 - 2 * v[x] @ v[other].T)) <= radius).tolist() if y is not None or a < b}
            assert len({p[:2] for p in got}) == len(got)
            assert {p[:2] for p in got if p[2]} <= true <= {p[:2] for p in got}


def test_codes_travel_and_vectors_stay(spark, monkeypatch):
    monkeypatch.setattr(rangejoin, "BLOCK_BYTES", 70_000)  # nine blocks
    rng = np.random.default_rng(5)
    v = _directions(rng, 6000)
    v[5000:] = v[:1000] + (0.05 * rng.random(1000))[:, None] * rng.normal(size=(1000, 64))
    v = v.astype(np.float32)
    vectors = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    folder = pathlib.Path(_checkpoint_root(spark).removeprefix("file:"))
    kept = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = kept()
    got = {r.vec_id: (r.n_links, r.component_id) for r in rangejoin.link_vectors(vectors).collect()}
    assert kept() - before < v.nbytes  # was over ten times as much
    u = v.astype(float)
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    at, to = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
    links, root = Counter([*at.tolist(), *to.tolist()]), list(range(6000))
    for a, b in zip(at.tolist(), to.tolist(), strict=True):  # pairs of a vector and its copy, or chains by chance
        p, q = min(root[a], root[b]), max(root[a], root[b])
        root = [p if r == q else r for r in root]
    assert len(at) > 300 and got == {i: (links[i], root[i]) for i in range(6000)}


def test_dense_labels_are_compared_by_their_vectors(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([_directions(rng, 1) + 0.0177 * rng.normal(size=(500, 64)), _directions(rng, 100)])
    codes, moved = closepairs.codes_of(v[:500] / np.sqrt((v[:500] ** 2).sum(axis=1))[:, None])
    block = rangejoin.Block()
    block.names, block.codes, block.moved = np.ones((500, 4), np.int64), codes, moved
    radius = float(np.sqrt(2 - 2 * 0.98))
    assert pa.Table.from_batches(rangejoin.compare_blocks(1, block, None, radius)).column("kind").to_pylist() == [rangejoin.DENSE]
    rows = [(i, x, i % 2 if i >= 500 else 0) for i, x in enumerate(v.tolist())] + [(7, v[7].tolist(), 0), (900, v[3].tolist(), 0), (901, v[550].tolist(), 0), (901, v[550].tolist(), 0)]
    got = rangejoin.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == links_by_hand([r for k, r in enumerate(rows) if r not in rows[:k]])


# WARC

def test_archives_come_back_as_written(spark, tmp_path):
    html = ["<p>short</p>", "é" * 9000 + "\r\n\r\nWARC/1.1\r\n", None, "", "<p>short</p>", "x" * 40_000, "tail\r\n\r\n", "é" * 9000 + "\r\n\r\nWARC/1.1\r\n"]
    pages = spark.createDataFrame([(i, f"http://a.example/{i}\n", h) for i, h in enumerate(html)] + [(None, None, "no id")], "page_id long, url string, html string")
    pages = pages.withColumn("size", F.lit(1)).withColumn("first", F.lit("x"))
    warc.write_archives(pages, str(tmp_path / "a"), segment_bytes=1000, records_per_file=2)
    records = warc.read_records(spark, str(tmp_path / "a"))
    assert records.filter("type = 'continuation'").count() > 40
    whole = {r.record_id: r for r in warc.reassemble(records.repartition(5)).collect()}
    for i, h in enumerate(html):
        r, first = whole[f"urn:x-page:{i}"], min(k for k, x in enumerate(html) if (x or "") == (h or ""))
        assert r.error is None and r.type == ("response" if first == i else "revisit")
        assert bytes(r.payload) == ((h or "").encode() if first == i else b"")
    got = {r.page_id: r for r in warc.resolve(warc.reassemble(records)).collect()}
    for i, h in enumerate(html):
        assert got[i].payload_bytes == len((h or "").encode()) and got[i].payload_digest == warc.digest_of((h or "").encode()) and got[i].error is None
    assert len(got) == len(html) and got[7].refers_to == 1 and got[3].refers_to == 2


def test_broken_records_say_what_is_wrong(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 5000), (2, "u", "z" * 5000), (3, "u", "z" * 5000)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "b"), segment_bytes=1000)
    records = warc.read_records(spark, str(tmp_path / "b"))
    lost = warc.reassemble(records.filter("NOT (origin = 'urn:x-page:1' AND segment = 3)"))
    assert {r.record_id: r.error for r in lost.collect()}["urn:x-page:1"] == "segment is missing"
    short = records.withColumn("total_length", F.col("total_length") + 1)
    assert {r.error for r in warc.reassemble(short.filter("segment > 0")).collect()} == {"total length differs"}
    twice = warc.reassemble(records.unionByName(records.filter("segment = 2")))
    assert {r.error for r in twice.collect()} == {None}
    alone = warc.resolve(warc.reassemble(records.filter("origin <> 'urn:x-page:2'")))
    assert {r.page_id: r.error for r in alone.collect()} == {1: None, 3: "original is missing"}
    warc.write_archives(pages.filter("false"), str(tmp_path / "c"))


def test_repeated_and_null_page_ids_have_a_record_each(spark, tmp_path):
    long_a, long_b = "a" * 4000, "b" * 4000
    rows = [(1, "u", "s"), (1, "u", "s"), (2, "u", "t"), (2, "u", "other"), (3, "u", long_a), (3, "u", long_a), (4, "u", long_a), (4, "u", long_b),
            (5, "u", "s"), (None, "u", "s"), (None, "u", "alone"), (None, "v", "alone"), (4, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "r"), segment_bytes=1000, null_ids=True)
    got = warc.resolve(warc.reassemble(warc.read_records(spark, str(tmp_path / "r")))).collect()
    least = {}
    for i, _, h in rows:
        least[h or ""] = min((x for x, _, g in rows if (g or "") == (h or "") and x is not None), default=None)
    want = [(i, len(h or ""), warc.digest_of((h or "").encode()), "response" if i == least[h or ""] else "revisit",
             None if i == least[h or ""] else least[h or ""], None) for i, _, h in rows]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_broken_headers_and_archives_give_error_rows(spark, tmp_path):
    block = warc.HTTP_BARE + b"hello"
    good = lambda i: warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x-page:{i}>")], block) + b"\r\n\r\n"
    bad = {
        "length is missing": b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:7>\r\n\r\nxx\r\n\r\n",
        "number is bad": b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:7>\r\nContent-Length: -4\r\n\r\nxx\r\n\r\n",
        "id or type is missing": b"WARC/1.1\r\nContent-Length: 2\r\n\r\nxx\r\n\r\n",
    }
    folder = tmp_path / "broken"
    folder.mkdir()
    for i, text in enumerate(bad.values()):
        (folder / f"part-{i}").write_bytes(good(10 * i) + text + good(10 * i + 1))
    (folder / "part-cut").write_bytes(good(50) + b"WARC/1.1\r\nWARC-Type: resp")
    (folder / "part-short").write_bytes(good(51) + good(52)[:-20])
    packed = gzip.compress(good(60)) + gzip.compress(good(61))
    (folder / "part-members").write_bytes(packed)
    (folder / "part-gzip").write_bytes(gzip.compress(good(62)) + gzip.compress(good(63))[:30])
    (folder / "part-noise").write_bytes(gzip.compress(good(64)) + b"noise")
    got = warc.reassemble(warc.read_records(spark, str(folder))).collect()
    assert sorted(r.record_id for r in got if r.error is None) == sorted(f"urn:x-page:{i}" for i in (0, 1, 10, 11, 20, 21, 50, 51, 60, 61, 62, 64))
    assert all(bytes(r.payload) == b"hello" for r in got if r.error is None)
    assert sorted(r.error for r in got if r.error) == sorted([
        *bad, "header is cut off", "block is cut off", "archive is cut off", "header is cut off", "archive is damaged"])
    told = warc.resolve(warc.reassemble(warc.read_records(spark, str(folder))))
    assert told.filter("error IS NULL").count() == 12 and told.filter("error IS NOT NULL").count() == 8


def test_chunked_framing():
    for payload in (b"", b"a", b"abc" * 5000):
        assert warc.dechunked(warc.chunked(payload, 7)) == payload
    assert warc.dechunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


# Tool calls

def test_whole_numbers_are_integers_however_written(spark):
    texts = {"1": True, "1.0": True, "1e2": True, "-0.0": True, "1e20": True, "12345678901234567890": True, "1.5": False, "1e-1": False, '"1"': False, "true": False, "null": False, "[1]": False}
    calls = spark.createDataFrame(
        [("k", str(i), "f", f'{{"n":{t}}}', None) for i, t in enumerate(texts)], "conv_id string, call_id string, name string, arguments string, follows string")
    results = spark.createDataFrame([], "conv_id string, call_id string, content string")
    schemas = spark.createDataFrame([("f", "n", "integer", True)], "name string, param string, type string, required boolean")
    got = {r.call_id: r.valid for r in toolcalls.link_calls(calls, results, schemas).collect()}
    assert got == {str(i): ok for i, ok in enumerate(texts.values())}


def test_calls_are_linked_ordered_and_checked(spark):
    calls = spark.createDataFrame([
        (1, "a", "search", '{"q": "x", "n": 3}', None), (1, "b", "search", '{"n":1.5,"q":"y"}', "a"), (1, "c", "search", '{"q":7,"extra":1}', "b"),
        (1, "d", "other", "{}", "c"), (1, "e", "search", "not json", "zz"), (1, "f", "search", "[1]", None), (1, "f", "search", "[1]", None),
        (2, "p", "search", '{"q":"s"}', "q"), (2, "q", "search", '{"q":"t"}', "p"), (2, "r", "search", None, None), (None, "x", "search", "{}", None),
        (3, "a", "nest", '{"o": {"z": [1, {"b": null, "a": "é\\n"}], "a": true}}', None),
    ], "conv_id long, call_id string, name string, arguments string, follows string").withColumn("level", F.lit(9)).withColumn("content", F.lit("x"))
    results = spark.createDataFrame([(1, "a", "one"), (1, "b", "two"), (1, "b", "two again"), (9, "a", "lost"), (3, "a", None), (1, None, "x")], "conv_id long, call_id string, content string")
    schemas = spark.sql("SELECT * FROM VALUES ('search','q','string',true), ('search','n','integer',false), ('nest','o','object',true) AS t(name,param,type,required)")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link_calls(calls, results, schemas).collect()}
    assert len(got) == 11
    assert [got[1, x].level for x in "abcde"] == [0, 1, 2, 3, 0] and got[2, "p"].level is None and "cycle" in got[2, "q"].errors
    assert got[1, "a"].valid and got[1, "a"].json == '{"arguments":{"n":3,"q":"x"},"call_id":"a","conv_id":1,"level":0,"name":"search","result":"one"}'
    assert got[1, "b"].errors == "wrong type of n; result repeats" and got[1, "c"].errors == "unknown extra; wrong type of q"
    assert got[1, "d"].errors == "unknown tool" and got[1, "e"].errors == "arguments are not JSON; follows an unknown call"
    assert got[1, "f"].errors == "arguments are not an object; call repeats" and got[2, "r"].errors == "missing q"
    assert got[9, "a"].status == "no call" and got[1, "c"].status == "no result" and got[3, "a"].status == "linked"
    assert json.loads(got[3, "a"].json)["arguments"] == {"o": {"a": True, "z": [1, {"a": "é\n", "b": None}]}}
    assert '{"o":{"a":true,"z":[1,{"a":"é\\n","b":null}]}}' in got[3, "a"].json
    assert toolcalls.link_calls(calls.filter("false"), results.filter("false"), schemas).count() == 0


def test_a_long_conversation_is_ordered(spark):
    calls = spark.range(700).select(F.lit(1).alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("follows"))
    assert all(r.level == int(r.call_id) for r in toolcalls.order_calls(calls).collect())


# The pipeline

def test_stages_keep_columns_and_drop_what_they_should(spark, small, sf_dir):
    names = small("documents").columns
    junk = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "12 34 !!", "en", "src0", 8), (9003, "", None, None, 0)], small("documents").schema)
    docs = small("documents").unionByName(junk)
    kept = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert kept.columns == names and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {9001, 9002, 9003}
    twice = small("documents").unionByName(small("documents").limit(5))
    left = corpus_pipeline.remove_near_duplicates(spark, twice, sf_dir)
    ids = [r.doc_id for r in left.collect()]
    from test_texts import classes_by_hand
    want, _ = classes_by_hand([(r.doc_id, r.text) for r in small("documents").collect()], 5)
    assert left.columns == names and sorted(ids) == sorted(i for i, c in want.items() if i == c)


def test_whole_run_ends_in_shards(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {r.shard for r in rows} == set(range(24))
    assert max(Counter(r.doc_id for r in rows).values()) <= 3
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_a_language_with_two_short_documents_is_kept(spark, small, sf_dir):
    rare = spark.createDataFrame([(-1, "今天早上下雨", "zh", "web", 6), (-2, "山水如畫", "zh", "web", 4)],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    docs = small("documents").select("doc_id", "text", "lang", "source", "n_chars").unionByName(rare)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf_dir).collect()}
    before = {r.doc_id for r in corpus_pipeline.identify_language(spark, small("documents"), sf_dir).collect()}
    assert kept == before | {-1, -2}


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, sf_dir):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.filter("false"), sf_dir).count() == 0
        stage(spark, plain, sf_dir).collect()
    assert langid.train(no_docs).langs == []


def test_native_operators_have_no_python_in_their_plans(spark, sf_dir):
    for name in ("op3_mixing", "op8_sharding", "op9_tool_calls"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct")), name
    assert importlib.util.find_spec("__spark_entry__") is not None
