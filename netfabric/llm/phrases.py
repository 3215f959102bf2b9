"""Phrase mining after Toivonen: a sample proposes, full passes decide.

1. Level by level, phrases that are frequent in a sample of documents at a lowered
   limit are proposed.
2. The proposed phrases and their negative border, every phrase that occurs and whose
   two parts, without its last and without its first word, are proposed, are counted
   over all documents: first by 64-bit hashes, which are small to shuffle and can only
   count too many, then, where a hash is frequent, exactly.
3. Frequent phrases of the border were missed by the sample.  What they would add to
   the border, what that would add in turn and so on all holds one of them.  So if there
   are any, a further pass counts every phrase that holds one, was not counted
   before and has no part that was found too rare, which closes the border at once.

A phrase occurs at most as often as its parts, so nothing frequent lies outside.  Sets
of phrases are sent to the tasks as bit arrays of bounded size: a false hit counts a
phrase too many, none is missed.  Counts are kept by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netfabric.llm import textbuf
from netfabric.llm.bpe import spread
from netfabric.session import cut_lineage

LONGEST = 5
MIN_COUNT = 100
UNKNOWN = "und"
#: Share of the documents in the sample.
SAMPLE = 0.125
#: A phrase that is just frequent has as many occurrences in the sample, less so many standard deviations.
SLACK = 0.5
#: Bits of the proposed set: 16 or more per phrase, at most 2^27 (16 MB).
BITS_PER_PHRASE = 16
MOST_BITS = 27
SEGMENT = 1 << 15
CHUNK = textbuf.CHUNK_BYTES * 2
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
#: What is neither a break nor a blank.
WORD = ~BREAK
WORD[[0x20, 0x09]] = False
PHRASE = ["lang", "size", "phrase"]


class Proposed(NamedTuple):
    """A set of phrases as bits; a phrase's place is its hash's first ``width`` bits."""

    bits: np.ndarray
    width: int

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.width)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def salts(langs: pa.Array) -> np.ndarray:
    """A hash of each language, the same in every batch."""
    names = [x.encode() for x in langs.to_pylist()]
    ends = np.cumsum([len(x) for x in names])
    return textbuf.hash_spans(np.frombuffer(b"".join(names), np.uint8), ends - [len(x) for x in names], ends, seed=1)


def longer(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all its words but the last and the last one's."""
    return textbuf.mix(hashes * np.uint64(textbuf.BASE) ^ word)


def lowered(texts: pa.Array, lang: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk of rows with words: lower-cased bytes, and start, end, language and piece of each word."""
    for chunk in textbuf.chunks(texts, CHUNK):
        data = textbuf.LOWER[chunk.data]
        starts, ends, bounds = textbuf.word_spans(WORD[data], chunk.offsets)
        if not len(starts):
            continue
        row = textbuf.owners(bounds)
        # Breaks so far and rows so far: neither falls, so two words with one sum have no break or row between them.
        yield data, starts, ends, lang[chunk.lo + row], np.cumsum(BREAK[data])[starts] + row


class Chunk(NamedTuple):
    """Words of some rows, lower-cased, each with a blank after it; codes are the same for equal words only."""

    spaced: np.ndarray
    edges: np.ndarray
    lang: np.ndarray
    piece: np.ndarray
    code: np.ndarray
    kinds: int
    hashes: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, piece: np.ndarray) -> Chunk:
        width = ends - starts
        first = np.cumsum(width + 1) - (width + 1)
        spaced = np.full(int((width + 1).sum()), 0x20, np.uint8)
        spaced[spread(first, width)] = data[spread(starts, width)]
        edges = np.append(first, len(spaced))
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(spaced.tobytes())])
        coded = column.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        return cls(spaced, edges, lang, piece, code, len(coded.dictionary), textbuf.hash_spans(data, starts, ends))

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        wide = self.edges[at + size] - 1 - self.edges[at]
        offsets = np.concatenate([[0], np.cumsum(wide)]).astype(np.int32)
        body = self.spaced[spread(self.edges[at], wide)].tobytes()
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(body)])

    def within(self, at: np.ndarray, size: int) -> np.ndarray:
        """Those of the starts ``at`` from which ``size`` words lie in one piece."""
        at = at[at + size <= len(self.code)]
        return at[self.piece[at] == self.piece[at + size - 1]]


def candidates(chunk: Chunk, salt: np.ndarray, proposed: Proposed | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(size, starts, numbers, hashes)`` of all words and of the phrases whose two parts are proposed candidates; equal ones have equal numbers."""
    n = len(chunk.code)
    at, gram, hashes = np.arange(n), chunk.lang * chunk.kinds + chunk.code, longer(salt, chunk.hashes)
    for size in range(1, longest + 1):
        if size > 1:
            inside = np.flatnonzero(proposed.holds(hashes))
            place = np.full(n + 1, -1, np.int64)
            place[at[inside]] = inside
            at = chunk.within(at[inside], size)
            at = at[place[at + 1] >= 0]
            here, last = place[at], at + size - 1
            gram, hashes = gram[here] * chunk.kinds + chunk.code[last], longer(hashes[here], chunk.hashes[last])
        if not len(at):
            return
        if size > 1:
            gram = np.unique(gram, return_inverse=True)[1]
        yield size, at, gram, hashes


def extensions(chunk: Chunk, salt: np.ndarray, proposed: Proposed, frequent: Proposed, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(size, starts, numbers, hashes)`` of the phrases that are no candidates and whose two parts are frequent, or are extensions themselves.

    Such a phrase holds one that is frequent and was not proposed, or it would be a candidate.
    """
    n = len(chunk.code)
    counted = {size: at for size, at, *_ in candidates(chunk, salt, proposed, longest)}
    hashes = longer(salt, chunk.hashes)
    gram, good = chunk.lang * chunk.kinds + chunk.code, np.flatnonzero(frequent.holds(hashes))
    for size in range(2, longest + 1):
        place = np.full(n + 1, -1, np.int64)
        place[good] = good
        at = chunk.within(good, size)
        at = at[place[at + 1] >= 0]
        if not len(at):
            return
        last = at + size - 1
        hashes[at] = longer(hashes[at], chunk.hashes[last])
        gram[at] = np.unique(gram[at] * chunk.kinds + chunk.code[last], return_inverse=True)[1]
        place[:] = 0
        place[counted.get(size, at[:0])] = 1
        known = place[at] == 1
        yield size, at[~known], gram[at[~known]], hashes[at[~known]]
        good = at[~known | frequent.holds(hashes[at])]


def count_chunk(
    chunk: Chunk, salt: np.ndarray, proposed: Proposed | None, frequent: Proposed | None, sizes: range,
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(size, start, n, hash)`` of each candidate of one chunk; with ``frequent``, of each extension."""
    if frequent is None:
        found = candidates(chunk, salt, proposed, sizes.stop - 1)
    else:
        found = extensions(chunk, salt, proposed, frequent, sizes.stop - 1)
    for size, at, gram, hashes in found:
        if size in sizes:
            _, one, counts = np.unique(gram, return_index=True, return_counts=True)
            yield size, at[one], counts, hashes[one]


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Chunk, np.ndarray]]:
    """Per chunk of rows ``(lang, text)``: names of the languages, words, and each word's language as a hash."""
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        salt = salts(names)
        for data, starts, ends, lang, piece in lowered(batch.column("text"), code):
            yield names, Chunk.of(data, starts, ends, lang, piece), salt[lang]


def count_hashes(docs: DataFrame, proposed: Proposed, sizes: range) -> DataFrame:
    """``(hash, n)`` over all candidates of ``docs (lang, text)``: no less than the count of any phrase with that hash."""
    shared = docs.sparkSession.sparkContext.broadcast(proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, salt in chunks_of(batches):
            for _, _, n, hashes in count_chunk(chunk, salt, shared.value, None, sizes):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return docs.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def count(
    docs: DataFrame, proposed: Proposed | None, sizes: range, frequent: Proposed | None = None, likely: Proposed | None = None,
) -> DataFrame:
    """``(lang, size, phrase, n)`` over all of ``docs (lang, text)``; with size 1, also rows of size 0 with all words of a language.

    Candidates are counted, or with ``frequent`` extensions; with ``likely`` only those whose hash it holds.
    """
    shared = docs.sparkSession.sparkContext.broadcast((proposed, frequent, likely))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, had, hoped = shared.value
        for names, chunk, salt in chunks_of(batches):
            if 1 in sizes:
                total = np.bincount(chunk.lang, minlength=len(names))
                here = np.flatnonzero(total)
                yield rows(names, here, total[here], pa.array([""] * len(here)))
            for size, at, n, hashes in count_chunk(chunk, salt, wanted, had, sizes):
                if hoped is not None:
                    keep = hoped.holds(hashes)
                    at, n = at[keep], n[keep]
                yield rows(names, chunk.lang[at], n, chunk.phrases(at, size))

    def rows(names: pa.Array, lang: np.ndarray, n: np.ndarray, phrase: pa.Array) -> pa.RecordBatch:
        # One key instead of two or three columns: a phrase has no tab.
        key = pc.binary_join_element_wise(names.take(pa.array(lang)), phrase, "\t")
        return pa.RecordBatch.from_arrays([key, pa.array(n.astype(np.int64))], ["key", "n"])

    counted = docs.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    phrase = F.substring_index("key", "\t", -1)
    size = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1)
    return counted.select(F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), size.alias("size"), phrase.alias("phrase"), "n")


def as_set(slots: DataFrame, width: int) -> Proposed:
    """The bits of ``slots (slot)``, combined on the executors in segments of 4 KB."""
    parts = slots.groupBy(F.expr(f"slot div {SEGMENT}").alias("part")).agg(F.expr(f"bitmap_construct_agg(slot % {SEGMENT})").alias("bits"))
    bits = np.zeros((1 << width) // 8, np.uint8)
    for row in parts.toLocalIterator():
        own = np.frombuffer(bytes(row["bits"]), np.uint8)
        bits[row["part"] * SEGMENT // 8 :][: len(own)] = own[: len(bits)]
    return Proposed(bits, width)


def propose(phrases: DataFrame, width: int) -> Proposed:
    """The set of ``phrases (lang, phrase)``."""

    @F.arrow_udf("long")
    def slot(langs: pa.Array, texts: pa.Array) -> pa.Array:
        coded = langs.dictionary_encode()
        salt = salts(coded.dictionary)[coded.indices.to_numpy()]
        out = np.zeros(len(texts), np.int64)
        for chunk in textbuf.chunks(texts):
            w = textbuf.words(chunk.data, chunk.offsets, ~WORD)
            h, have = salt[chunk.lo : chunk.hi], np.diff(w.bounds)
            for k in range(int(have.max(initial=0))):
                h = np.where(have > k, longer(h, w.hashes[np.minimum(w.bounds[:-1] + k, len(w.hashes) - 1)]), h)
            out[chunk.lo : chunk.hi] = (h >> np.uint64(64 - width)).astype(np.int64)
        return pa.array(out)

    return as_set(phrases.select(slot("lang", "phrase").alias("slot")), width)


def width_for(phrases: int) -> int:
    return min(MOST_BITS, max(16, (phrases * BITS_PER_PHRASE).bit_length()))


def sample_phrases(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """``(lang, size, phrase)`` of up to ``longest - 1`` words that ``docs`` hold at least ``least`` times, level by level."""
    found, proposed = [], None
    for size in range(1, max(2, longest)):
        level = cut_lineage(count(docs, proposed, range(size, size + 1)).filter((F.col("size") > 0) & (F.col("n") >= least)).select(*PHRASE))
        found.append(level)
        if (n := level.count()) == 0 or size + 1 == longest:
            break
        # The phrases of a level have a width of their own; the levels below are in its parts.
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        proposed = propose(every, width_for(n + sum(x.count() for x in found[:-1])))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def frequent_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, sample: float = SAMPLE,
    text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", lowest: int | None = None,
) -> DataFrame:
    """``(lang, size, phrase, n)`` of all phrases of 1 to ``longest`` words that a language holds ``min_count`` times or more.

    Rows of size 0 have all words of a language.  Texts are lower-cased (A-Z), cut at
    ``. , ; : ! ?`` and line breaks, and split at blanks and tabs; occurrences may
    overlap and do not cross a cut.  A null language is ``und``; a null, empty or
    wordless text holds nothing.  Every row counts, repeats too, whatever its id.  The
    sample is drawn by a hash of id and text and decides the work, never the result;
    ``lowest`` is its limit (by default, ``SLACK`` deviations under the expected count).
    An empty table gives no rows.  Columns of other names are ignored.
    """
    source = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mean = min_count * sample
    least = lowest or max(2, int(mean - SLACK * (mean * (1 - sample)) ** 0.5))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), "text", F.lit("sample")), F.lit(1 << 40)) < int(sample * (1 << 40))
    texts = source.select("lang", "text")
    known = cut_lineage(sample_phrases(cut_lineage(source.filter(drawn).select("lang", "text")), least, longest))
    often = (F.col("n") >= min_count) | (F.col("size") == 0)
    proposed = propose(known, width_for(known.count()))
    hashed = cut_lineage(count_hashes(texts, proposed, range(1, longest + 1)).filter(F.col("n") >= min_count).select("hash"))
    width = width_for(hashed.count())
    likely = as_set(hashed.select(F.shiftrightunsigned("hash", 64 - width).alias("slot")), width)
    frequent = cut_lineage(count(texts, proposed, range(1, longest + 1), likely=likely).filter(often))
    inner = frequent.filter((F.col("size") > 0) & (F.col("size") < longest)).select(*PHRASE)
    if not inner.join(known, PHRASE, "left_anti").take(1):
        return frequent
    added = count(texts, proposed, range(2, longest + 1), propose(inner, width_for(inner.count()))).filter(often)
    return cut_lineage(frequent.unionByName(added))


def collocations(frequent: DataFrame, top: int = 2000, absorbed_percent: int = 100) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of two or more words of each language.

    A phrase scores ``floor(1000 a n / (l r))`` at the cut into two parts, of ``l`` and
    ``r`` occurrences, where that is lowest, the first of equal ones.  A phrase inside
    another one with ``absorbed_percent`` of its occurrences is left out.  Ranks go by
    score, then ``a``, both falling, then by the phrase's bytes.  All numbers are exact.
    """
    phrases = frequent.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    parts = frequent.filter("size > 0").select("lang", "phrase", F.col("n").alias("f"))
    totals = frequent.filter("size = 0").select("lang", "n")
    # What a longer phrase absorbs, its parts with one word less absorb as well, so those are enough.
    inside = phrases.filter("size > 2").select(
        "lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"),
        F.col("a").alias("held"))
    held = inside.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    own = phrases.join(held, ["lang", "phrase"], "left").filter(
        f"held IS NULL OR 100 * cast(held AS decimal(38, 0)) < {int(absorbed_percent)} * cast(a AS decimal(38, 0))").drop("held")
    cuts = own.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - size)").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = "cast({} AS decimal(19, 0))".format
    score = F.expr(f"cast(1000 AS decimal(4, 0)) * ({wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    scored = cuts.join(totals, "lang").select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


PHRASES_SQL = r"""
WITH piece AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM piece
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i : i + size - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(ws) >= size
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100
), total AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang
), cand AS (
  SELECT * FROM f WHERE size > 1
), inner_part AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + k - 1], ' ') AS phrase, max(f) AS held
  FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM cand WHERE size > 2)) GROUP BY 1, 2
), own AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a FROM cand c LEFT JOIN inner_part h ON h.lang = c.lang AND h.phrase = c.phrase
  WHERE h.held IS NULL OR 100 * h.held < 100 * c.f
), cut AS (
  SELECT *, array_to_string(string_split(phrase, ' ')[: k], ' ') AS p1, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS p2
  FROM (SELECT *, unnest(range(1, size)) AS k FROM own)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, c.k, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.p1 JOIN f y ON y.lang = c.lang AND y.phrase = c.p2 JOIN total t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
) WHERE rank <= 2000
"""
