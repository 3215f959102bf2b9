"""Byte-level BPE, periodic runs and phrases against other libraries, brute force and SQL, and on odd rows."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_texts import spark_rows, sql_rows

from netfabric.llm import bpe, linededup, minhash, phrases, queries, runs, textbuf

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_phrases"])
def test_query_equals_its_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(sf_dir, queries.ORACLES[name])


# Hashes

def thue_morse(a, b, n):
    """Strings whose polynomial sums modulo 2^64 are equal for every odd base."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join((a, b)[k] for k in bits), "".join((b, a)[k] for k in bits)


@pytest.mark.parametrize("n", [1024, 4096])
@pytest.mark.parametrize("letters", ["ab", "zq"])
def test_strings_built_to_clash_have_different_hashes(n, letters):
    pair = [x.encode() for x in thue_morse(*letters, n)]
    data = np.frombuffer(b"".join(pair), np.uint8)
    starts = np.array([0, n])
    for seed in range(3):
        assert len(set(textbuf.hash_spans(data, starts, starts + n, seed).tolist())) == 2
    assert len({tuple(x) for x in textbuf.key_digests(data, starts, starts + n).tolist()}) == 2


def test_span_hashes_depend_on_the_span_only():
    rng = random.Random(1)
    spans = ["".join(rng.choice("ab\0é") for _ in range(rng.choice([0, 1, 7, 8, 9, 16, 63, 64, 65, 200]))).encode() for _ in range(400)]
    alone = [int(textbuf.hash_spans(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in spans]
    ends = np.cumsum([len(x) for x in spans])
    together = textbuf.hash_spans(np.frombuffer(b"".join(spans), np.uint8), ends - [len(x) for x in spans], ends)
    assert together.tolist() == alone
    assert len(set(alone)) == len(set(spans))


@pytest.mark.parametrize("n", [1024, 4096])
def test_clashing_lines_are_kept_apart(spark, n):
    a, b = thue_morse("a", "b", n)
    docs = spark.createDataFrame([(1, a), (2, a), (3, b)], "doc_id long, text string")
    dropped = linededup.drop_lines(docs, linededup.build_index(docs)).select("doc_id", "n_dropped").collect()
    assert sorted(tuple(r) for r in dropped) == [(1, 0), (2, 0), (3, 0)]


@pytest.mark.parametrize("n", [1024, 4096])
def test_clashing_words_do_not_link_texts(spark, n):
    a, b = thue_morse("a", "b", n)
    docs = spark.createDataFrame([(1, f"one {a} two"), (2, f"one {b} two"), (3, f"one {a} two")], "doc_id long, text string")
    found = minhash.near_duplicates(docs, shingle=2, percent=80).select("doc_id", "component_id").collect()
    assert sorted(tuple(r) for r in found) == [(1, 1), (2, 2), (3, 1)]


# Byte-level BPE

@pytest.fixture(scope="module")
def reference():
    with open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def ids_of(column):
    return [np.frombuffer(x, "<u4").tolist() for x in column.to_pylist()]


def test_the_perfect_hash_is_minimal_and_rejects_all_others(vocabulary):
    made = vocabulary.whole
    assert sorted(made.key_at.tolist()) == list(range(len(vocabulary.tokens)))
    assert made.find(made.data, made.starts, made.ends).tolist() == list(range(made.size))
    other = [t + b"\x00!" for t in vocabulary.tokens if t + b"\x00!" not in set(vocabulary.tokens)] + [b""]
    assert (made.find(*bpe.byte_spans(pa.array(other, pa.binary()))) == -1).all()
    assert bpe.PerfectHash([]).find(*bpe.byte_spans(pa.array([b"a"], pa.binary()))).tolist() == [-1]
    assert bpe.PerfectHash([b"a"]).find(*bpe.byte_spans(pa.array([b"a", b"b"], pa.binary()))).tolist() == [0, -1]


def test_ids_equal_those_of_the_tokenizer_library(vocabulary, reference, monkeypatch):
    parts = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "1", "é", "ß", "　", "!", "ab", "Word", "\x85", "Ⅷ", "²", "̀", "\x1c", "語", "🙂",
             "՘", "\U000323b1", "ᇞ0", "<|endoftext|>"]
    rng = random.Random(2)
    texts = ["", None, " ", "  a", "don't we'LL 's's ''s", "x" * 5000, "ab" * 3000 + "c", " " * 300, "a\n\n b\r\n", *(
        "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000))]
    want = [reference.encode_ordinary(t or "") for t in texts]
    for block in (bpe.BLOCK, 16):
        monkeypatch.setattr(bpe, "BLOCK", block)
        made = vocabulary.encode(pa.array(texts))
        assert ids_of(made) == want
        assert vocabulary.decode(made).to_pylist() == [(t or "").encode() for t in texts]
    assert ids_of(vocabulary.encode(pa.array(texts).slice(5, 9))) == want[5:14]
    assert vocabulary.decode(made.slice(5, 9)).to_pylist() == [(t or "").encode() for t in texts[5:14]]


def test_a_worker_that_remembers_nothing_finds_the_same(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    text = "unusualish wordlings wordlings zzyzxing " * 20
    assert ids_of(vocabulary.encode(pa.array([text, text]))) == [reference.encode_ordinary(text)] * 2


def test_a_vocabulary_needs_every_byte():
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0}, r"\w+")


def test_op11_equals_the_tokenizer_library_on_the_whole_table(spark, sf_dir, small, reference):
    want = {}
    for r in small("documents").select("doc_id", "text").collect():
        ids = reference.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    found = {r[0]: tuple(r)[1:] for r in queries.op11_byte_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert found == want


def test_bpe_on_odd_rows(odd_docs, no_docs, vocabulary, reference):
    coded = bpe.encode_and_decode(odd_docs, vocabulary, F.col("text"))
    assert coded.columns == [*odd_docs.columns, "_coded"]
    rows = coded.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert np.frombuffer(r["_coded"]["ids"], "<u4").tolist() == reference.encode_ordinary(r["text"] or "")
        assert bytes(r["_coded"]["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode_and_decode(no_docs, vocabulary, F.col("text")).count() == 0
    encode, decode, _ = bpe.coder(odd_docs.sparkSession, vocabulary)
    apart = odd_docs.select("text", decode(encode(F.col("text"))).alias("again")).collect()
    assert all(bytes(r["again"]).decode() == (r["text"] or "") for r in apart)


# Runs

def runs_by_force(words, min_length, min_exponent):
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    every = sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))
    gone = {k for s, size, q in every for k in range(s + q, s + size)}
    return every, " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_texts(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        letters = "abcdefghijklmnopqrst"[: rng.choice([1, 2, 3, 5, 20])]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            unit, at = [rng.choice(letters) for _ in range(rng.randint(1, 20))], rng.randint(0, len(words))
            words[at:at] = (unit * rng.randint(2, 8))[: rng.randint(len(unit), 8 * len(unit))]
        yield words


@pytest.mark.parametrize(("min_length", "min_exponent"), [(24, 3), (6, 3), (3, 3), (10, 4), (25, 7)])
def test_runs_equal_brute_force(min_length, min_exponent):
    texts = [*periodic_texts(400, min_length), [], ["x"] * 200, ["é", "é́"] * 30]
    found = runs.runs_of(pa.array([None, *("\t ".join(w) for w in texts)]), min_length, min_exponent).to_pylist()
    assert found[0] == {"runs": [], "collapsed": ""}
    for words, r in zip(texts, found[1:], strict=True):
        every, rest = runs_by_force(words, min_length, min_exponent)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == every
        assert r["collapsed"] == rest


def test_long_periodic_texts_take_little_time():
    unit = [f"w{k}" for k in range(37)]
    passage = [w for k in range(2000) for w in [*unit, f"end{k}"]]
    found = runs.runs_of(pa.array([" ".join(unit * 2000), "x " * 60_000, " ".join(passage)]), 24, 3).to_pylist()
    assert [[tuple(x.values()) for x in r["runs"]] for r in found] == [[(0, 74_000, 37)], [(0, 60_000, 1)], []]
    assert found[0]["collapsed"] == " ".join(unit) and found[1]["collapsed"] == "x"


def test_runs_need_three_periods():
    with pytest.raises(ValueError):
        runs.find_runs(None, None, 24, 2)


def test_runs_on_odd_rows(odd_docs, no_docs):
    found = runs.find_runs(odd_docs, F.col("text"))
    assert found.columns == [*odd_docs.columns, "_found"]
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if len(r["text"] or "") < 1000:
            assert r["_found"]["runs"] == [] and r["_found"]["collapsed"] == " ".join((r["text"] or "").split())
    assert runs.find_runs(no_docs, F.col("text")).count() == 0
    odd = runs.repeat_words(odd_docs, "doc_id", "text")
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count()


# Phrases

def phrases_by_force(rows, least, longest):
    found, total = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for part in low.split("\n"):
            words = [w for w in part.replace("\t", " ").split(" ") if w]
            total[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    found[lang or "und", size, " ".join(words[k : k + size])] += 1
    return {k: n for k, n in found.items() if n >= least} | {(lang, 0, ""): n for lang, n in total.items() if n}


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(4)
    words = ["a", "b", "c", "Delta", "é", "　x", "f-g"]
    return [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " "]) for _ in range(rng.randint(0, 60))))
            for _ in range(120)] + [("en", None), ("en", ""), (None, " . ")]


@pytest.mark.parametrize("lowest", [1, 4, 1_000_000])
def test_phrases_equal_brute_force_whatever_the_sample_proposes(spark, phrase_rows, lowest, monkeypatch):
    monkeypatch.setattr(textbuf, "CHUNK_BYTES", 1 << 10)
    docs = spark.createDataFrame([(k, lang, text) for k, (lang, text) in enumerate(phrase_rows)], "doc_id long, lang string, text string")
    found = phrases.frequent_phrases(docs, min_count=6, longest=5, sample=0.3, lowest=lowest)
    assert {(r.lang, r.size, r.phrase): r.n for r in found.collect()} == phrases_by_force(phrase_rows, 6, 5)


def test_scores_are_exact_beyond_64_bits(spark):
    n, a, left, right = 9 * 10**12, 7 * 10**9 + 1, 8 * 10**9 + 3, 7 * 10**9 + 5
    rows = [("x", 0, "", n), ("x", 1, "p", left), ("x", 1, "q", right), ("x", 2, "p q", a), ("x", 2, "q q", 100), ("x", 3, "p q q", 100), ("x", 2, "p p", 100)]
    frequent = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    found = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.collocations(frequent, top=10).collect()}
    assert found["p q"] == (a, left, right, 1000 * a * n // (left * right))
    # "q q" lies in "p q q" with all its occurrences; the cut after one word scores lower than that after two.
    cuts = {1: (left, 100), 2: (a, right)}
    assert set(found) == {"p q", "p q q", "p p"} and found["p q q"][3] == min(1000 * 100 * n // (x * y) for x, y in cuts.values())
    assert [r["rank"] for r in phrases.collocations(frequent, top=2).orderBy("rank").collect()] == [1, 2]


def test_phrases_on_odd_rows(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()]
    found = phrases.frequent_phrases(odd_docs, min_count=2, longest=3, sample=0.5)
    assert {(r.lang, r["size"], r.phrase): r.n for r in found.collect()} == phrases_by_force(rows, 2, 3)
    assert phrases.collocations(phrases.frequent_phrases(no_docs)).count() == 0


def test_ties_in_rank_go_by_bytes(spark):
    words = defaultdict(int)
    for lang, size, phrase, n in [("x", 2, "é a", 10), ("x", 2, "z a", 10), ("x", 2, "Z a", 10)]:
        words[lang, size, phrase] = n
    rows = [(*k, n) for k, n in words.items()] + [("x", 0, "", 1000), ("x", 1, "a", 30), ("x", 1, "é", 10), ("x", 1, "z", 10), ("x", 1, "Z", 10)]
    frequent = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    assert [r.phrase for r in phrases.collocations(frequent).orderBy("rank").collect()] == ["Z a", "z a", "é a"]
