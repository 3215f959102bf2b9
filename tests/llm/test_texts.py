"""Line dedup, language, toxicity, MinHash and decontamination against brute force, and on odd rows."""

import gc
import weakref
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netfabric.llm import components, decontaminate, langid, linededup, minhash, queries, textbuf, toxicity
from netfabric.llm.linededup import CuckooFilter


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return sorted((tuple(str(v) for _, v in sorted(zip(names, r, strict=True))) for r in rel.fetchall()))


def spark_rows(df):
    return sorted(tuple(str(v) for _, v in sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_mixing", "op7_warc", "op9_tool_calls"])
def test_query_equals_its_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(sf_dir, queries.ORACLES[name])


def test_words_and_hashes_of_a_column():
    texts = ["one  two\tthree", "", None, " one", "two\x0b", "drei vier fünf"]
    found = []
    for chunk in textbuf.chunks(pa.array(texts), limit=8):
        w = textbuf.words(chunk.data, chunk.offsets)
        raw = chunk.data.tobytes()
        for i in range(chunk.hi - chunk.lo):
            found.append([(raw[w.starts[k] : w.ends[k]], int(w.hashes[k])) for k in range(w.bounds[i], w.bounds[i + 1])])
    assert [[x for x, _ in row] for row in found] == [(t or "").encode().split() for t in texts]
    by_word = defaultdict(set)
    for row in found:
        for word, h in row:
            by_word[word].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({*map(tuple, by_word.values())}) == len(by_word)


# Lines

def test_cuckoo_filter_holds_what_was_inserted_and_loses_what_was_deleted():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    made = linededup.filled(h1, h2)
    assert made.contains(h1, h2).all()
    other = rng.integers(-(1 << 62), 1 << 62, (2, 20_000))
    assert made.contains(*other).mean() < 0.002
    made.delete(h1[:4000], h2[:4000])
    assert made.contains(h1[4000:], h2[4000:]).all()
    assert made.contains(h1[:4000], h2[:4000]).mean() < 0.002
    assert made.insert(h1[:4000], h2[:4000]) and made.contains(h1, h2).all()


def test_a_full_filter_says_so():
    rng = np.random.default_rng(2)
    assert not CuckooFilter(16).insert(*rng.integers(0, 1 << 62, (2, 500)))


def lines_by_hand(rows, min_docs=3):
    docs = defaultdict(set)
    key = lambda line: line.encode().strip().lower().decode()
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 20:
                    docs[key(line)].add(i)
    gone = {k: max(v) for k, v in docs.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def dropped(docs, index, **more):
    return sorted((tuple(r) for r in linededup.drop_lines(docs, index, **more).collect()), key=str)


def test_lines_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert dropped(odd_docs, linededup.build_index(odd_docs)) == lines_by_hand(rows)
    assert dropped(no_docs, linededup.build_index(no_docs)) == []


def test_lines_with_shards_divided_into_groups(small):
    docs = small("documents")
    index = linededup.build_index(docs, shards=8)
    assert dropped(docs, index, group_refs=50) == dropped(docs, index) == lines_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_inserted_and_deleted_documents_leave_the_index_as_built(small):
    docs = small("documents")
    first, rest = docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0")
    whole = linededup.build_index(docs, shards=4)
    grown = linededup.insert_documents(linededup.build_index(first, shards=4), rest)
    assert dropped(docs, grown) == dropped(docs, whole)
    back = linededup.delete_documents(grown, rest.select("doc_id"))
    built = linededup.build_index(first, shards=4)
    assert dropped(first, back) == dropped(first, built)
    rows = lambda x: sorted(map(tuple, x.counts.collect()))
    assert rows(back) == rows(built)


# Language

def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(~queries.held_out()))
    found = langid.identify(docs.filter(queries.held_out()), model, F.col("text"))
    right = found.agg(F.avg((F.col("_lang.lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.98
    # The same text in capitals, and one word of it, is still of its language.
    assert langid.predict_batch(model, pa.array(["THE THING OF THE", "und nicht die"])).field("lang_pred").to_pylist() == ["en", "de"]


def test_language_of_odd_rows(odd_docs, no_docs):
    model = langid.train(odd_docs, min_count=1)
    rows = langid.identify(odd_docs, model, F.col("text")).select("text", "_lang.*", "label").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) and 0 <= r.score <= 1 and r.label == "label"
    assert langid.train(no_docs).langs == []
    assert langid.identify(no_docs, model, F.col("text")).count() == 0
    untaught = langid.identify(odd_docs, langid.train(no_docs), F.col("text"))
    assert {r.lang_pred for r in untaught.select("_lang.*").collect()} == {"und"}


def test_false_positives_are_corrected():
    grams = {"lang": ["a"] * 4000 + ["b"] * 4000, "gram": np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 8000)}
    import pandas as pd
    tight = langid.build_filter(["a", "b"], pd.DataFrame(grams), bits_per_gram=2)
    other = np.random.default_rng(4).integers(0, 1 << 62, 50_000).astype(np.uint64)
    masks = np.bitwise_and.reduce([tight.slots[at] for at in langid.slot_of(other, len(tight.slots))])
    for k in range(2):
        measured = ((masks[:, 0] >> np.uint64(k)) & np.uint64(1)).mean()
        assert abs(measured - tight.noise[k]) < 0.02


def test_more_than_64_languages():
    import pandas as pd
    langs = [f"l{i:03d}" for i in range(130)]
    rng = np.random.default_rng(5)
    grams = pd.DataFrame({"lang": np.repeat(langs, 20), "gram": rng.integers(-(1 << 62), 1 << 62, 2600)})
    made = langid.build_filter(langs, grams, 16)
    for k in (0, 64, 129):
        own = grams[grams.lang == langs[k]].gram.to_numpy().view(np.uint64)
        masks = np.bitwise_and.reduce([made.slots[at] for at in langid.slot_of(own, len(made.slots))])
        assert ((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()


# Toxicity

def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter(~queries.held_out()))
    scored = toxicity.score_toxicity(docs.filter(queries.held_out()), model, F.col("text")).join(labels, "doc_id").select("toxic", "_toxicity").toPandas()
    rank = scored["_toxicity"].rank()
    y = scored["toxic"] == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.94 and ((scored["_toxicity"] >= 0.5) == y).mean() > 0.97
    # Misspellings that no text had share n-grams with words that many had.
    plain = "the thing of the onder and anter with the eren"
    scores = toxicity.score_batch(model, pa.array([plain, plain + " idiot moron", plain + " idiotts morons", plain + " the inder"]))
    assert scores[1] > 0.5 and scores[2] > scores[3] and scores[0] < 0.5


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, 0), (4, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.score_toxicity(odd_docs, model, F.col("text")).select("text", "_toxicity").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["_toxicity"] <= 1 for r in rows)
    assert len({r["_toxicity"] for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.score_toxicity(no_docs, toxicity.train(no_docs, labels), F.col("text")).count() == 0


# Near duplicates

def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def smallest_reachable(ids, pairs):
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def classes_by_hand(rows, k):
    sets = sets_of(rows, k)
    ids = sorted(sets)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return smallest_reachable(ids, pairs), {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(small, k):
    rows = [(r.doc_id, r.text) for r in small("documents").collect()]
    want, sizes = classes_by_hand(rows, k)
    got = minhash.near_duplicates(small("documents"), shingle=k).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_of_near_copies_are_followed(spark):
    """Each copy differs from the one before by a few words, the ends share little; other copies sit around a middle."""
    words = [f"w{i}" for i in range(60)]
    rows, now = [], list(words)
    for i in range(40):
        rows.append((100 + i, " ".join(now)))
        now[(7 * i) % 60] = f"x{i}"
    rng = np.random.default_rng(6)
    middle = [f"m{i}" for i in range(50)]
    for i in range(80):
        own = list(middle)
        for j in rng.choice(50, int(rng.integers(0, 6)), replace=False):
            own[j] = f"y{i}.{j}"
        rows.append((int(rng.integers(1, 90)) * 1000 + i, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in got} == classes_by_hand(rows, 2)[0]


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs, shingle=2).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[9].component_id == 8 and by_id[8].kept and not by_id[9].kept
    assert all(by_id[i].component_id == i and by_id[i].n_shingles == 0 for i in (4, 5, 6))
    assert sum(r.doc_id is None and r.component_id is None and not r.kept for r in got) == 2
    assert minhash.near_duplicates(no_docs, shingle=2).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    rng = np.random.default_rng(7)
    edges = [(i, i + 1) for i in range(300, 400)] + [(1000, 1000 + i) for i in range(1, 200)] + [(51, 50), (52, 51), (50, 52), (60, 60)]
    edges += [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (250, 2))]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = smallest_reachable({x for e in edges for x in e}, edges)
    assert {r.id: r.component for r in got} == {k: v for k, v in want.items() if k != 60 and (v != k or any(k in e and e[0] != e[1] for e in edges))}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Decontamination

def test_planted_passages_are_found_and_clean_rows_left(spark, small):
    items = small("benchmark").limit(10).collect()
    plain = [r.text for r in small("documents").filter("lang = 'en'").limit(30).collect()]
    rows, want = [], set()
    for n, item in enumerate(items):
        words = item.text.split()
        reworded = [("other" if k % 6 == 3 else w.upper()) for k, w in enumerate(words)]
        rows += [(n, plain[n][:900] + " " + item.text + " " + plain[n + 1][:700]), (100 + n, plain[n][:300] + " " + ", ".join(reworded) + " end")]
        want |= {(n, item.item_id), (100 + n, item.item_id)}
    rows += [(200 + n, "entirely new prose about gardens number " + " ".join(f"plant{n * k}" for k in range(80))) for n in range(10)]
    rows += [(300, None), (301, ""), (302, " .,; ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("terms", F.lit("x"))
    marks = spark.createDataFrame([(r.item_id, r.text) for r in items] + [(900, None), (901, ""), (902, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, marks).collect()}
    assert want <= got and not {d for d, _ in got if d >= 200}
    assert decontaminate.find_contamination(docs.filter("false"), marks).count() == 0
    assert decontaminate.find_contamination(docs, marks.filter("false")).count() == 0
    assert decontaminate.find_contamination(docs, marks, group_bytes=1).count() == len(got)


def test_recall_of_the_latent_candidates_alone(spark, small, monkeypatch):
    """Verbatim and reworded passages at any place, found by the candidates that the query takes, without exact counts."""
    monkeypatch.setattr(decontaminate, "RANK", 16)
    docs, marks = small("documents"), small("benchmark")
    source = docs.select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    [space] = list(decontaminate.fit_spaces(source, marks, "item_id", "text"))
    assert space.latent.shape[0] < len(space.words) / 1.5
    items = {r.item_id: r.text.lower() for r in marks.collect()}
    prose = " ".join(r.text.lower() for r in docs.filter("lang = 'en'").limit(20).collect()).split()
    rng, want, texts = np.random.default_rng(5), [], []
    poor = {int(space.items[p]) for p in space.poor}
    for n, (item, text) in enumerate((k, t) for k, t in items.items() if k not in poor):
        words = text.split()
        for part in (0.0, 0.15, 0.3):
            reworded = [f"new{n}" if rng.random() < part else w for w in words]
            at = int(rng.integers(0, 400))
            texts.append(" ".join(prose[at : at + int(rng.integers(0, 90))] + reworded + prose[at + 100 : at + 200]))
            want.append((part, item))
    hit = defaultdict(list)
    found = [set() for _ in texts]
    for chunk in textbuf.chunks(pa.array(texts)):
        for row, _, k, share in decontaminate.candidates(space._replace(counts=None), decontaminate.words_of(chunk)):
            found[chunk.lo + row].add(int(space.items[k]))
    for got, (part, item) in zip(found, want, strict=True):
        hit[part].append(item in got)
    assert {p: np.mean(x) >= 0.97 for p, x in hit.items()} == {0.0: True, 0.15: True, 0.3: True}
    # Few others: the latent space tells passages apart.
    assert np.mean([len(got) for got in found]) < 3


def test_verbatim_passages_are_found_however_large_the_corpus_and_the_leak(spark):
    leak = " ".join(f"asked{i} of the" for i in range(8))
    filler = " ".join(f"other{i}" for i in range(60))
    marks = spark.createDataFrame([(1, leak), (2, "one item that no text holds at all")], "item_id long, text string")
    text = F.concat(F.lit(filler + " of the "), F.when(F.col("id") % 3 == 0, leak).otherwise("end"), F.lit(" " + filler))
    third = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = decontaminate.find_contamination(third, marks).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 1) for i in range(0, 3000, 3)} and {r.lcs_share for r in got} == {1.0}
    every = third.filter("doc_id % 3 = 0")
    assert decontaminate.find_contamination(every, marks).count() == 1000
    few = "the of a to in is it"
    one = F.when(F.col("id") == 77_777, F.lit(f"{filler} {' '.join(f'{w} rare{i}' for i, w in enumerate(few.split()))} {filler}")).otherwise(few)
    large = spark.range(400_000).select(F.col("id").alias("doc_id"), one.alias("text"))
    marks = spark.createDataFrame([(3, " ".join(f"{w} rare{i}" for i, w in enumerate(few.split())))], "item_id long, text string")
    assert [(r.doc_id, r.lcs_share) for r in decontaminate.find_contamination(large, marks).collect()] == [(77_777, 1.0)]


def test_every_stretch_with_most_of_a_passage_is_found(spark, small):
    docs, marks = small("documents"), small("benchmark")
    passages = [decontaminate.words_of(c).hashes for r in marks.collect() for c in textbuf.chunks(pa.array([r.text.lower()]))]
    ids = [r.item_id for r in marks.collect()]
    alone, either = set(), set()
    for doc in docs.collect():
        w = next(decontaminate.words_of(c).hashes for c in textbuf.chunks(pa.array([(doc.text or "").lower()])))
        for first in range(0, max(1, len(w) - decontaminate.STEP), decontaminate.STEP):
            stretch = w[max(0, first - decontaminate.WINDOW) : first + 2 * decontaminate.WINDOW]
            for item, passage in zip(ids, passages, strict=True):
                share, answer = decontaminate.verify(passage, stretch)
                if share >= decontaminate.LCS_ALONE:
                    alone.add((doc.doc_id, item))
                if share >= decontaminate.LCS_WITH_ANSWER and answer >= decontaminate.ANSWER:
                    either.add((doc.doc_id, item))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, marks).collect()}
    assert alone and alone <= got <= alone | either


def test_one_group_of_spaces_is_held_at_a_time(spark, small, monkeypatch):
    docs, marks = small("documents").limit(50), small("benchmark")
    want = sorted(map(tuple, decontaminate.find_contamination(docs, marks).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 4)
    fit, made, alive, most = decontaminate.fit_spaces, [], [], []

    def watched(*args):
        for space in fit(*args):
            axes = space.axes.copy()
            made.append(1)
            alive.append(weakref.ref(axes))
            space = space._replace(axes=axes)
            del axes
            yield space
            del space
            gc.collect()
            most.append(sum(r() is not None for r in alive))

    monkeypatch.setattr(decontaminate, "fit_spaces", watched)
    got = decontaminate.find_contamination(docs, marks, group_bytes=1).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == want and len(made) > 3 and max(most) <= 1


def test_common_subsequence():
    assert decontaminate.lcs(np.array([1, 2, 3, 4]), np.array([9, 1, 3, 9, 4])) == 3
    assert decontaminate.lcs(np.array([1]), np.array([], int)) == 0


def test_held_out_rows_are_a_fifth_by_checksum(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), queries.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
